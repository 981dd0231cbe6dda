"""Data-set operators over ``row_id, y, features`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform

TRAIN, TEST, VALIDATE = "train", "test", "validate"


def is_empty(rows: DataFrame) -> bool:
    return rows.isEmpty()


def dataset_size(rows: DataFrame) -> int:
    return 0 if rows.isEmpty() else rows.count()


def dimension_frame(rows: DataFrame) -> DataFrame:
    """Largest active feature id (0 for an empty set), as a one-row frame.
    Rows without features are ignored (Q20)."""
    return (rows.select(F.explode("features").alias("e"))
            .agg(F.coalesce(F.max("e.feature_id"), F.lit(0)).cast("bigint").alias("dimension")))


def dataset_dimension(rows: DataFrame) -> int:
    return int(dimension_frame(rows).first()["dimension"])


def project_inputs(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "features")


def project_targets(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "y")


def transpose(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Feature-major (CSC) view: ``feature_id, row_id, value`` range-partitioned
    and sorted by ``(feature_id, row_id)``.  A feature's column is a run of
    consecutive rows that may span partitions, so a hot feature is never one
    task; nothing is collected into one list."""
    ent = rows.select("row_id", F.inline("features"))
    n = partitions or rows.sparkSession.sparkContext.defaultParallelism
    return (ent.repartitionByRange(n, "feature_id", "row_id")
            .sortWithinPartitions("feature_id", "row_id")
            .select("feature_id", "row_id", "value"))


def split_thresholds(train: float, test: float, validate: float = 0.0) -> tuple[float, float]:
    """Cumulative bounds of the normalised weights (Q22: train and test must
    be non-zero; validation optional)."""
    if train == 0 or test == 0:
        raise ValueError("both a training and a test weight are required")
    if min(train, test, validate) < 0:
        raise ValueError("weights must not be negative")
    total = train + test + validate
    return train / total, (train + test) / total


def random_split(rows: DataFrame, train: float, test: float, validate: float = 0.0,
                 seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """Adds ``split``: each row draws ``u = md5(seed:row_id)`` once and falls
    into train / test / validate by the cumulative weights.  Unlike
    ``randomSplit`` the result does not depend on partitioning or on a
    re-computation, and no shuffle is needed."""
    a, b = split_thresholds(train, test, validate)
    u = hash_uniform(seed, F.col(id_col))
    part = F.when(u < F.lit(a), F.lit(TRAIN)).when(u < F.lit(b), F.lit(TEST)).otherwise(F.lit(VALIDATE))
    if validate <= 0:
        part = F.when(u < F.lit(a), F.lit(TRAIN)).otherwise(F.lit(TEST))
    return rows.withColumn("split", part)


def split_sets(rows_with_split: DataFrame) -> dict[str, DataFrame]:
    return {s: rows_with_split.where(F.col("split") == s).drop("split")
            for s in (TRAIN, TEST, VALIDATE)}


def collection_dimension(rows_with_split: DataFrame, num_features: int = 0) -> DataFrame:
    """``num_features`` if given, else the largest dimension over the splits
    (Q2: the original returned a row count here)."""
    if num_features > 0:
        return rows_with_split.sparkSession.createDataFrame([(num_features,)], "dimension bigint")
    per = (rows_with_split.select("split", F.explode("features").alias("e"))
           .groupBy("split").agg(F.max("e.feature_id").alias("d")))
    return per.agg(F.coalesce(F.max("d"), F.lit(0)).cast("bigint").alias("dimension"))
