from pyspark.sql import functions as F

from fmlattice.functions import (epoch_to_days, format_compact, hash_gauss, hash_uniform,
                                 split_list, trunc_div)


def test_split_drops_trailing_empties_like_the_jvm(spark):
    df = spark.createDataFrame([("a,b,,",), ("",), (",",), (",a",), ("a||b|",)], "s string")
    out = df.select(split_list("s", ",").alias("t"), split_list("s", "|").alias("p")).collect()
    assert out[0]["t"] == ["a", "b"]
    assert out[1]["t"] == [""]          # '' stays one empty token
    assert out[2]["t"] == []            # a lone separator gives none
    assert out[3]["t"] == ["", "a"]     # leading empty piece is kept
    assert out[4]["p"] == ["a", "", "b"]   # separator is literal, not a regex


def test_format_compact(spark):
    vals = [-0.0004, 0.0, 0.0625, 0.5, 1234567.0, 2.9996, -0.02, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(format_compact("x")).collect()]
    assert got == ["-0", "0", "0.062", "0.5", "1234567", "3", "-0.02", "10"]


def test_epoch_days_truncate_toward_zero(spark):
    df = spark.createDataFrame([(86399,), (86400,), (-1,), (-86401,), (1704067207,)], "s long")
    got = [r[0] for r in df.select(epoch_to_days("s")).collect()]
    assert got == [0.0, 1.0, 0.0, -1.0, 19723.0]
    got = [r[0] for r in df.select(trunc_div(F.col("s"), 7)).collect()]
    assert got == [int(v / 7) for v in (86399, 86400, -1, -86401, 1704067207)]


def test_hash_draws_are_deterministic_and_in_range(spark):
    df = spark.range(2000).select(hash_uniform(5, F.col("id")).alias("u"),
                                  hash_gauss(0.0, 1.0, 5, F.col("id")).alias("g"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("g"), F.stddev("g")).first()
    assert 0 < r[0] and r[1] < 1
    assert abs(r[2]) < 0.1 and abs(r[3] - 1) < 0.1
    a = df.repartition(7).orderBy("u").collect()
    b = df.orderBy("u").collect()
    assert a == b


def test_ntz_epoch_days_ignore_session_time_zone(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59, 59, 500000),), (dt.datetime(1969, 12, 31, 12, 0),)],
                               "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    got = []
    for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        got.append([r[0] for r in df.select(epoch_to_days("ts", "timestamp_ntz")).collect()])
    spark.conf.set("spark.sql.session.timeZone", old)
    assert got[0] == got[1] == got[2] == [19723.0, 0.0]


def test_one_character_is_split_by_without_a_pattern(spark):
    from fmlattice.functions.columns import quote_regex, split_keep_java
    from pyspark.sql import functions as F
    assert quote_regex(",") == "," and quote_regex("|") == "\\|" and quote_regex("::") == "\\Q::\\E"
    for sep in ".$|()[]{}^?*+\\,;- #&~/":
        row = spark.range(1).select(*[split_keep_java(F.lit(t.replace("_", sep)), sep) for t in ("a_b", "_a__b__", "", "__", "ab")]).first()
        assert [list(x) for x in row] == [["a", "b"], ["", "a", "", "b"], [""], [], ["ab"]], sep
