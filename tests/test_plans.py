"""Plan shapes the design relies on, read from ``explain`` output."""

import contextlib
import io

from fmlattice.operators import als as A
from fmlattice.operators import model as M
from fmlattice.session import Scratch

from conftest import SF


def plan_text(df, mode="simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_scoring_pass_needs_no_shuffle_after_the_placed_rows(spark):
    from fmlattice.plans.catalog import orders_relation_vectorized
    vec = orders_relation_vectorized(spark, SF, drop_segment=False)
    rows, _ = A.place_rows(vec.rows, Scratch(spark, "plan"))
    cfg = M.FMConfig(k=2)
    params = M.init_params(spark, vec.dimension, cfg)
    text = plan_text(A.residuals(rows, params, 0.0, cfg, vec.dimension))
    assert "Exchange" not in text.replace("BroadcastExchange", "")
    assert "BroadcastHashJoin" in text


def test_vectorizer_scan_is_pruned_and_lookups_broadcast(spark):
    from fmlattice.plans.catalog import orders_relation_vectorized
    text = plan_text(orders_relation_vectorized(spark, SF).rows)
    scans = [ln for ln in text.splitlines() if "FileScan parquet" in ln and "o_orderkey" in ln]
    assert scans and all("o_orderdate" not in ln for ln in scans)
    assert "SortMergeJoin" not in text.split("InMemoryRelation")[0]
    assert text.count("BroadcastHashJoin") >= 4


def test_over_the_broadcast_bound_joins_shuffle_with_equal_results(spark):
    from fmlattice.plans.catalog import orders_relation_vectorized

    def rows():
        vec = orders_relation_vectorized(spark, SF)
        return vec, sorted((r["row_id"], tuple((e["feature_id"], e["value"]) for e in r["features"]))
                           for r in vec.rows.collect())
    _, small = rows()
    spark.conf.set("fmlattice.broadcastBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vec, big = rows()
        text = plan_text(vec.rows)
    finally:
        spark.conf.unset("fmlattice.broadcastBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert big == small
    assert "SortMergeJoin" in text.split("InMemoryRelation")[0]


def shuffles_before_aggregation(text: str) -> bool:
    """Whether an Exchange feeds the partial sums over the rows."""
    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))
    lines = text.splitlines()
    at = next(i for i, ln in enumerate(lines) if "partial_sum" in ln)
    for ln in lines[at + 1:]:
        if depth(ln) <= depth(lines[at]):
            return False
        if "Exchange" in ln:
            return True
    return False


def test_wide_block_and_side_statistics_combine_before_the_shuffle(spark):
    """Above every broadcast bound the sums by feature or key are partial first: a hot
    feature or key with a third of the rows is no single task."""
    from fmlattice.operators import relational as RL
    from fmlattice.plans import catalog as C
    from fmlattice.plans import fixtures as X
    spark.conf.set("fmlattice.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        work, block, params = C._after_bias(spark, SF, "v0")
        work = Scratch(spark, "plan").write(work)
        text = plan_text(A.theta_stats(work, params, 0, block, "v0"))
        assert not shuffles_before_aggregation(text), text
        d = C.orders_relational(spark, SF)
        state = RL.relational_residuals(d, d.fact, M.init_params(spark, d.dimension, X.LEARN_CFG), 0.0, X.LEARN_CFG)
        state = Scratch(spark, "plan").write(state)
        sums = Scratch(spark, "plan").write(RL.side_sums(
            d.relations[0].rows, M.init_params(spark, d.dimension, X.LEARN_CFG), X.LEARN_CFG, d.dimension))
        text = plan_text(RL.relation_cache(state, d.relations[0], None, 0, d.dimension, sums=sums))
        assert not shuffles_before_aggregation(text), text
    finally:
        spark.conf.unset("fmlattice.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segment_steps_and_state_need_no_shuffle_of_rows(spark):
    from fmlattice.plans import catalog as C
    train, params, dim = C.events_learning(spark, SF)
    from fmlattice.plans import fixtures as X
    start = A.start_pass(train, params, 0.0, X.LEARN_CFG, dim)
    text = plan_text(A.work_frame(train.segments[0], start.errors, start.sums, 0))
    assert "Exchange" not in text, text
    assert not {"features", "y"} & set(start.errors.columns + start.sums.columns)


def test_predict_shuffles_each_row_once(spark):
    from fmlattice.plans import catalog as C
    from fmlattice.plans import fixtures as X
    vec = C.events_vectorized(spark, SF, X.EVENTS_MODEL_SPECS)
    rows = Scratch(spark, "plan").write(vec.rows)
    text = plan_text(M.predict(rows, M.init_params(spark, vec.dimension, X.SCORE_CFG), 0.0, X.SCORE_CFG, vec.dimension))
    assert text.replace("BroadcastExchange", "").count("Exchange") == 1 and "SortMergeJoin" not in text


def test_hot_tokens_are_spread_without_adaptive_execution(spark):
    """A third of the rows on one token and one key, above every broadcast bound: no task
    gets all of them, and the rows are the same."""
    from pyspark.sql import functions as F

    from fmlattice.operators.fields import Identity, List, Target
    from fmlattice.operators.relations import Relation, relation_vectorize
    from fmlattice.operators.vectorize import standard_vectorize
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("c"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("uid"),
        F.when(F.col("id") % 3 == 1, "hot|x").otherwise(F.concat(F.lit("y|z"), F.col("id") % 300)).alias("l"), F.lit(0.0).alias("y"))
    side = spark.range(300).select(F.col("id").alias("uid"), (F.col("id") % 5).cast("string").alias("g"))
    plain = [Identity("c"), Target("y")]
    related = [Identity("uid"), Target("y")]
    rel = {"uid": Relation(side, [Target("uid"), Identity("g")])}

    def entries(rows):
        return sorted((r["row_id"], [tuple(e) for e in r["features"]]) for r in rows.collect())

    listed = [List("l", sep="|"), Target("y")]
    want = [entries(standard_vectorize(df, plain, row_id="id").rows), entries(standard_vectorize(df, listed, row_id="id").rows),
            entries(relation_vectorize(df, related, rel, row_id="id").rows)]
    bounds = {"fmlattice.broadcastRows": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in bounds.items():
        spark.conf.set(name, value)
    try:
        vecs = [standard_vectorize(df, plain, row_id="id"), standard_vectorize(df, listed, row_id="id"),
                relation_vectorize(df, related, rel, row_id="id")]
        assert all(t in v.learned.hot[0] for t, v in zip(("hot", "hot", "7"), vecs))
        for v in (vecs[0], vecs[2]):
            sizes = [r["count"] for r in v.rows.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 0.45 * 6000, sizes         # 4 partitions; a hot one would hold half
        assert [entries(v.rows) for v in vecs] == want
    finally:
        for name in bounds:
            spark.conf.unset(name)
