"""The driver's tables as the library's inputs: field definitions and
configurations shared by the registered queries, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fields import Identity, List, Number, Target, Time
from ..operators.model import FMConfig
from ..session import ensure_checkpoint_dir

# Fixed values of the query set (parameters, not data).
EVENTS_TARGET_CENTER = 50.0
EVENTS_TARGET_SCALE = 100.0
PRICE_SCALE = 1e4
ACCTBAL_SCALE = 1e4
SCORE_CFG = FMConfig(k=2, init_stdev=0.1, seed=7)
SCORE_W0 = 0.25
SCORE_W_STDEV = 0.1
LEARN_CFG = FMConfig(k=2, iterations=2, init_stdev=0.1, seed=3, regv=10.0)
SPLIT_WEIGHTS = (0.8, 0.2, 0.0)
SPLIT3_WEIGHTS = (0.6, 0.3, 0.1)
SPLIT_SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events_target(c):
    return (c - F.lit(EVENTS_TARGET_CENTER)) / F.lit(EVENTS_TARGET_SCALE)


def price_target(c):
    return c / F.lit(PRICE_SCALE)


def acctbal_number(c):
    return c / F.lit(ACCTBAL_SCALE)


# events: ratings-like, flat
EVENTS_SPECS = [Identity("user_id"), Identity("event_type"), Time("ts"),
                Target("value", transform=events_target)]
EVENTS_MODEL_SPECS = [Identity("user_id"), Identity("event_type"),
                      Target("value", transform=events_target)]

# orders: ratings-like with a relation to customer
ORDERS_SPECS = [Identity("o_custkey"), Identity("o_orderpriority"), Identity("o_orderstatus"),
                Target("o_totalprice", transform=price_target)]
CUSTOMER_SPECS = [Target("c_custkey"), Identity("c_mktsegment"), Identity("c_nationkey"),
                  Number("c_acctbal", transform=acctbal_number)]

# part: list field (name tokens) + identities
PART_SPECS = [List("p_name", sep=" "), Identity("p_brand"), Identity("p_type"),
              Number("p_size"), Target("p_retailprice")]

# part as a training set: the list's tokens meet in rows
PART_PRICE_SCALE = 1000.0
PART_SIZE_SCALE = 50.0
PART_FIT_SPECS = [List("p_name", sep=" "), Identity("p_brand"), Identity("p_type"),
                  Number("p_size", transform=lambda c: c / F.lit(PART_SIZE_SCALE)),
                  Target("p_retailprice", transform=lambda c: c / F.lit(PART_PRICE_SCALE))]
ONE_PASS_CFG = LEARN_CFG.with_(iterations=1)

# lineitem's two side tables
PART_SIDE_SPECS = [Target("p_partkey"), List("p_name", sep=" "), Identity("p_brand")]
SUPPLIER_SPECS = [Target("s_suppkey"), Identity("s_nationkey"), Number("s_acctbal", transform=acctbal_number)]

# a chain of side tables: supplier -> nation -> region
SUPPLIER_KEY_SPECS = [Target("s_suppkey"), Identity("s_nationkey"), Number("s_acctbal", transform=acctbal_number)]
NATION_SPECS = [Target("n_nationkey"), Identity("n_regionkey")]
REGION_SPECS = [Target("r_regionkey"), Identity("r_name")]
# regions that have no row in the chain, so that their nations keep the key's one-hot
REGION_DROPPED = "ASIA"

# strengths (of w, of v) of the attribute groups of orders -> customer; the others have the model's
GROUP_REG = {1: (0.5, 2.0), 2: (0.25, 4.0), 3: (0.0, 1.0), 5: (2.0, 20.0)}

# users whose id this divides are not in the dictionary that encode_unseen learns
UNSEEN_MODULUS = 3

# side table with natural misses: customers outside one market segment
RELATION_DROP_SEGMENT = "BUILDING"
