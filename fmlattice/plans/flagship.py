"""The flagship job (``__spark_entry__.entry``) and the demo pipeline it
follows: orders joined to their customers, vectorized, split 80/20, an FM fit
by coordinate descent (k = 2), and the held-out rows scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import als as A
from ..operators import dataset as D
from ..operators import model as M
from ..operators.blocks import conflict_free_blocks
from . import fixtures as X
from .catalog import orders_relation_vectorized

FLAGSHIP_CFG = M.FMConfig(k=2, iterations=2, init_stdev=0.1, seed=3)


def demo_pipeline(spark: SparkSession, sf_dir: str, cfg: M.FMConfig = FLAGSHIP_CFG):
    vec = orders_relation_vectorized(spark, sf_dir, drop_segment=False)
    split = D.random_split(vec.rows, *X.SPLIT_WEIGHTS, seed=X.SPLIT_SEED)
    sets = D.split_sets(split)
    blocks = conflict_free_blocks(sets["train"], vec.blocks())
    model = A.fit(sets["train"], cfg, vec.dimension, blocks)
    scored = M.predict(sets["test"], model.params, model.w0, cfg, vec.dimension)
    return vec, model, scored


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, scored = demo_pipeline(spark, sf_dir)
    return scored.select(F.col("row_id").alias("o_orderkey"), "y", "prediction")
