"""fmlattice: feature engineering and factorization machines as Spark jobs."""

__version__ = "0.1.0"
