import pytest
from pyspark.sql import functions as F

from fmlattice.operators import dataset as D


def rows(spark, n=5000):
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit(1.0).alias("y"),
                                 F.array(F.struct((F.col("id") % 17).alias("feature_id"),
                                                  F.lit(1.0).alias("value"))).alias("features"))


def test_split_is_deterministic_and_proportional(spark):
    r = rows(spark)
    a = D.random_split(r, 0.6, 0.3, 0.1, seed=4)
    b = D.random_split(r.repartition(3), 0.6, 0.3, 0.1, seed=4)
    ca = {x["split"]: x["count"] for x in a.groupBy("split").count().collect()}
    assert sorted(map(tuple, a.select("row_id", "split").collect())) == \
        sorted(map(tuple, b.select("row_id", "split").collect()))
    assert abs(ca["train"] / 5000 - 0.6) < 0.03 and abs(ca["validate"] / 5000 - 0.1) < 0.02
    two = D.random_split(r, 0.8, 0.2)
    assert {x["split"] for x in two.select("split").distinct().collect()} == {"train", "test"}


def test_split_refuses_zero_weights(spark):
    with pytest.raises(ValueError):
        D.random_split(rows(spark), 0.0, 1.0)


def test_size_dimension_empty_transpose(spark):
    r = rows(spark, 100)
    assert D.dataset_size(r) == 100 and D.dataset_dimension(r) == 16
    assert D.is_empty(r.where("row_id < 0")) and D.dataset_size(r.where("row_id < 0")) == 0
    assert D.dataset_dimension(r.where("row_id < 0")) == 0
    t = D.transpose(r, 4).collect()
    keys = [(x["feature_id"], x["row_id"]) for x in t]
    assert keys == sorted(keys) and len(keys) == 100
