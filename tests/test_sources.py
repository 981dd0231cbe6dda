from fmlattice.operators.fields import Identity, Number, Target
from fmlattice.operators.vectorize import standard_vectorize
from fmlattice.session import scratch_path
from fmlattice.sources import (filter_comment_blank, libfm_dimension, libfm_lines, read_delimited,
                               read_libfm, write_libfm)


def test_libfm_round_trip_with_equal_bases(spark):
    df = spark.createDataFrame([(1, "a", 0.25, 3.0), (2, "b", 0.0, -1.0), (3, "a", 1.5, 0.5)],
                               "id long, c string, x double, y double")
    vec = standard_vectorize(df, [Identity("c"), Number("x"), Target("y")], row_id="id")
    path = scratch_path(spark, "rt")
    write_libfm(vec.rows, path, index_base=1)
    back = read_libfm(spark, path, index_base=1)
    got = sorted((r["y"], [(e["feature_id"], e["value"]) for e in r["features"]]) for r in back.collect())
    want = sorted((r["y"], [(e["feature_id"], e["value"]) for e in r["features"]]) for r in vec.rows.collect())
    assert got == want
    # default bases shift ids by one, as the original does
    shifted = read_libfm(spark, path)
    assert libfm_dimension(shifted) == vec.dimension


def test_libfm_lines_format_and_comments(spark):
    rows = spark.createDataFrame([(5.0, [(0, 1.0), (8, 1.0), (13, 1 / 3)])],
                                 "y double, features array<struct<feature_id:bigint,value:double>>")
    assert libfm_lines(rows).first()["value"] == "5 1:1 9:1 14:0.333"
    lines = spark.createDataFrame([("# comment",), ("",), ("  3 2:1 9:1  ",), ("   ",)], "value string")
    kept = [r["value"] for r in filter_comment_blank(lines).collect()]
    assert kept == ["3 2:1 9:1"]


def test_read_delimited(spark):
    path = scratch_path(spark, "delim")
    spark.createDataFrame([("1::a::x",), ("2::b::",), ("3::::c",)], "value string").coalesce(1).write.text(path)
    got = [r["fields"] for r in read_delimited(spark, path, "::").collect()]
    assert got == [["1", "a", "x"], ["2", "b"], ["3", "", "c"]]


def test_read_libfm_min_partitions(spark):
    path = scratch_path(spark, "minp")
    spark.createDataFrame([(f"{i % 3} {i + 1}:1",) for i in range(50)], "value string") \
         .coalesce(1).write.text(path)
    rows = read_libfm(spark, path, min_partitions=4, assign_ids=False)
    assert rows.rdd.getNumPartitions() >= 4 and rows.count() == 50
    assert libfm_dimension(rows) == 50


def test_write_libfm_full_precision_round_trips_exactly(spark):
    rows = spark.createDataFrame([(1, 0.1 + 0.2, [(0, 1 / 3), (5, -2.5e-7)])],
                                 "row_id long, y double, features array<struct<feature_id:bigint,value:double>>")
    path = scratch_path(spark, "full")
    write_libfm(rows, path, index_base=0, precision=None)
    back = read_libfm(spark, path, index_base=0).first()
    assert back["y"] == 0.1 + 0.2
    assert [(e["feature_id"], e["value"]) for e in back["features"]] == [(0, 1 / 3), (5, -2.5e-7)]


def test_trim_as_the_jvm(spark):
    lines = spark.createDataFrame([("\t",), ("\t# note",), (" \t1 2:3\t\r",)], "value string")
    assert [r["value"] for r in filter_comment_blank(lines).collect()] == ["1 2:3"]


def test_precision(spark):
    rows = spark.createDataFrame([(0.123456, [(0, 2 / 3)])],
                                 "y double, features array<struct<feature_id:bigint,value:double>>")
    assert libfm_lines(rows, precision=5).first()["value"] == "0.12346 1:0.66667"
    assert libfm_lines(rows, precision=0).first()["value"] == "0 1:1"
    import pytest
    with pytest.raises(ValueError):
        libfm_lines(rows, precision=-1)


def test_a_line_is_split_once(spark):
    from fmlattice.sources.text import parse_libfm
    lines = spark.createDataFrame([("5 1:1  9:0.5",), ("3",)], "value string")
    rows = parse_libfm(lines)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1
    assert [(r["y"], [tuple(e) for e in r["features"]]) for r in rows.collect()] == [(5.0, [(1, 1.0), (9, 0.5)]), (3.0, [])]
