"""FM parameters, scoring and evaluation.

``params``: ``feature_id bigint, w double, v0 .. v{k-1} double`` (k is a plan
time constant, so the factors are columns and every sum stays inside
whole-stage codegen).  ``w0`` is one scalar.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_gauss
from ..session import fits_broadcast


@dataclass(frozen=True)
class FMConfig:
    k: int = 8
    iterations: int = 100
    reg0: float = 0.0
    regw: float = 0.0
    regv: float = 10.0
    init_mean: float = 0.0
    init_stdev: float = 0.01
    seed: int = 0
    k0: bool = True   # use the global bias
    k1: bool = True   # use the linear terms

    def with_(self, **kw) -> FMConfig:
        return replace(self, **kw)


@dataclass
class FMModel:
    w0: float
    params: DataFrame
    cfg: FMConfig
    dimension: int
    trace: DataFrame | None = None

    def save(self, path: str) -> None:
        """Write the model below ``path``: ``params`` (one row a feature) and ``meta`` (one row)."""
        spark = self.params.sparkSession
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        meta = json.dumps({"w0": self.w0, "dimension": self.dimension, "cfg": asdict(self.cfg)})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "FMModel":
        """The model written by ``save`` (without its trace)."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        return FMModel(meta["w0"], spark.read.parquet(f"{path}/params"), FMConfig(**meta["cfg"]), meta["dimension"])

    def grown(self, dimension: int) -> "FMModel":
        """The model for a larger dimension: the new features' parameters as they are before
        any training, the others unchanged."""
        if dimension < self.dimension:
            raise ValueError(f"the model has {self.dimension} features, not fewer ({dimension})")
        more = init_params(self.params.sparkSession, dimension, self.cfg).where(F.col("feature_id") >= self.dimension)
        return FMModel(self.w0, self.params.unionByName(more), self.cfg, dimension, self.trace)


def vcols(k: int) -> list[str]:
    return [f"v{f}" for f in range(k)]


def init_params(spark, dimension: int, cfg: FMConfig) -> DataFrame:
    """w = 0 and v_f(i) ~ N(init_mean, init_stdev) for every feature id in
    ``0 .. dimension-1``, drawn from md5(seed:f:i) so any engine (and any
    partitioning) gives the same numbers.  Built with ``spark.range``: no
    feature-sized data on the driver."""
    ids = spark.range(0, max(dimension, 0)).withColumnRenamed("id", "feature_id")
    return ids.select("feature_id", F.lit(0.0).alias("w"),
                      *[hash_gauss(cfg.init_mean, cfg.init_stdev, cfg.seed, f, F.col("feature_id"))
                        .alias(f"v{f}") for f in range(cfg.k)])


def join_params(entries: DataFrame, params: DataFrame, k: int, dimension: int | None = None,
                own: str = "row_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``w, v*`` to long-form entries; broadcast the parameter table only
    when its size (``dimension``) is known to be under the bound.  Where it shuffles,
    rows without a feature get keys of their own (``own``)."""
    p = params.select("feature_id", "w", *vcols(k), *extra)
    if dimension is not None and fits_broadcast(entries.sparkSession, dimension, dimension * 8 * (k + 2)):
        return entries.join(F.broadcast(p), "feature_id", "left")
    key = F.coalesce("feature_id", F.lit(-1).cast("bigint") - F.pmod(F.xxhash64(own), F.lit(1 << 40)))
    p = p.withColumnRenamed("feature_id", "_pid")
    return entries.withColumn("_key", key).join(p, F.col("_key") == F.col("_pid"), "left").drop("_key", "_pid")


def entry_sums(k: int) -> list[Column]:
    """``lin = Σ w x``, ``s_f = Σ v_f x``, ``ss_f = Σ (v_f x)^2``."""
    x = F.col("value")
    aggs = [F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * x).alias("lin")]
    for f in range(k):
        vx = F.coalesce(F.col(f"v{f}"), F.lit(0.0)) * x
        aggs += [F.sum(vx).alias(f"s{f}"), F.sum(vx * vx).alias(f"ss{f}")]
    return aggs


def score_sums(rows: DataFrame, params: DataFrame, cfg: FMConfig, dimension: int | None = None,
               ) -> DataFrame:
    """Per row id: ``lin = Σ w x``, ``s_f = Σ v_f x``, ``ss_f = Σ (v_f x)^2``.
    Rows without features get no row here (see ``predict``).  Features
    missing from ``params`` contribute 0 (Q15)."""
    ent = rows.select("row_id", F.inline("features"))
    return join_params(ent, params, cfg.k, dimension).groupBy("row_id").agg(*entry_sums(cfg.k))


def interaction_expr(k: int) -> Column:
    out = F.lit(0.0)
    for f in range(k):
        s, ss = F.col(f"s{f}"), F.col(f"ss{f}")
        out = out + F.lit(0.5) * (s * s - ss)
    return out


def predict(rows: DataFrame, params: DataFrame, w0: float, cfg: FMConfig,
            dimension: int | None = None, parts: str = "all", unseen: str = "skip") -> DataFrame:
    """``row_id, y, prediction``; an empty row scores ``w0`` (Q20).
    ``parts``: ``all``, ``linear`` (w0 + Σwx) or ``interactions``.  A feature that the
    model lacks contributes 0 or, with ``unseen="error"``, raises (Q15).

    Rows are told apart by a number drawn here, so rows that share an id each get
    their own score; the target rides along, so each row is shuffled once."""
    if unseen not in ("error", "skip"):
        raise ValueError(f"unknown unseen policy {unseen!r}; error or skip")
    numbered = rows.select("row_id", "y", "features").withColumn("_u", F.monotonically_increasing_id())
    ent = numbered.select("_u", "row_id", "y", F.inline_outer("features"))
    j = join_params(ent, params.withColumn("_known", F.lit(True)), cfg.k, dimension, own="_u", extra=("_known",))
    x, aggs = F.col("value"), []
    if unseen == "error":
        x = F.when(F.col("feature_id").isNotNull() & F.col("_known").isNull(), F.raise_error(
            F.concat(F.lit("feature not in the model: "), F.col("feature_id").cast("string"))).cast("double")).otherwise(x)
    grouped = j.withColumn("value", x).groupBy("_u").agg(
        F.first("row_id").alias("row_id"), F.first("y").alias("y"), *entry_sums(cfg.k))
    lin = F.coalesce(F.col("lin"), F.lit(0.0)) if cfg.k1 else F.lit(0.0)
    inter = F.coalesce(interaction_expr(cfg.k), F.lit(0.0))
    bias = F.lit(float(w0)) if cfg.k0 else F.lit(0.0)
    if parts == "linear":
        pred = bias + lin
    elif parts == "interactions":
        pred = inter
    else:
        pred = bias + lin + inter
    return grouped.select("row_id", "y", pred.alias("prediction"))


# ---- metrics: one-row DataFrames ------------------------------------------

def rmse(scored: DataFrame) -> DataFrame:
    d = F.col("y") - F.col("prediction")
    return scored.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def mean_signed_error(scored: DataFrame) -> DataFrame:
    """Σ(y − ŷ)/n: the number the original reports as 'MAE' (Q3)."""
    return scored.agg(F.avg(F.col("y") - F.col("prediction")).alias("mean_signed_error"))


def mae(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"))


def sign_accuracy(scored: DataFrame) -> DataFrame:
    """Share of rows whose target and score have the same sign (≥ 0 is
    positive); a real division (Q4)."""
    same = ((F.col("y") >= 0) & (F.col("prediction") >= 0)) | \
           ((F.col("y") < 0) & (F.col("prediction") < 0))
    return scored.agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("sign_accuracy"))
