import pytest
from pyspark.sql import functions as F

from fmlattice.operators.dictionary import dense_ids
from fmlattice.operators.fields import Identity, List, Number, Target, Time, split_target_inputs
from fmlattice.operators.vectorize import fields_to_columns, filter_arity, standard_vectorize


def rows_of(vec):
    return {r["row_id"]: (r["y"], [(e["feature_id"], e["value"]) for e in r["features"]])
            for r in vec.rows.collect()}


def test_identity_list_number_time(spark):
    df = spark.createDataFrame([
        (1, "b", "x|y|x", 2.0, 86400, 5.0),
        (2, "a", "y", 0.0, 0, 3.0),
        (3, "b", "z|", -1.5, 172800, -1.0),
    ], "id long, cat string, tags string, num double, ts long, target double")
    specs = [Identity("cat"), List("tags", sep="|"), Number("num"), Time("ts"), Target("target")]
    vec = standard_vectorize(df, specs, row_id="id")
    assert [(f.offset, f.size) for f in vec.layout] == [(0, 2), (2, 3), (5, 1), (6, 1)]
    r = rows_of(vec)
    # 'x|y|x': x twice -> one entry, weight 1/3 (duplicates count in m)
    assert r[1] == (5.0, [(1, 1.0), (2, 1 / 3), (3, 1 / 3), (5, 2.0), (6, 1.0)])
    # zero number and zero days are absent (a sparse vector stores no zeros)
    assert r[2] == (3.0, [(0, 1.0), (3, 1.0)])
    # 'z|': trailing empty piece dropped -> one token
    assert r[3] == (-1.0, [(1, 1.0), (4, 1.0), (5, -1.5), (6, 2.0)])
    assert vec.dimension == 7


def test_exactly_one_target():
    with pytest.raises(ValueError):
        split_target_inputs([Identity("a")])
    with pytest.raises(ValueError):
        split_target_inputs([Target("a"), Target("b")])


def test_arity_filter_and_positions(spark):
    raw = spark.createDataFrame([(["1", "a", "5"],), (["2", "b"],), (["3", "c", "7", "x"],)],
                                "fields array<string>")
    cols = fields_to_columns(filter_arity(raw, 3), 3)
    assert [tuple(r) for r in cols.collect()] == [("1", "a", "5")]


def test_distributed_numbering_equals_window(spark):
    toks = spark.createDataFrame([(f"t{i % 997:04d}",) for i in range(5000)], "token string")
    d = toks.distinct()
    a, n1 = dense_ids(d, max_single_task=10 ** 9)
    b, n2 = dense_ids(d, max_single_task=10)      # forces the range-partitioned path
    assert n1 == n2 == 997
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r["code"] for r in b.collect()) == list(range(997))


def test_dictionary_is_lexicographic(spark):
    df = spark.createDataFrame([(10, 0.0), (9, 0.0), (100, 0.0)], "k long, y double")
    vec = standard_vectorize(df, [Identity("k"), Target("y")])
    assert {r["token"]: r["code"] for r in vec.dictionary.collect()} == {"10": 0, "100": 1, "9": 2}


def test_assigned_row_ids_are_stable(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, y double")
    vec = standard_vectorize(df, [Identity("c"), Target("y")])
    a = sorted((r["row_id"], r["y"]) for r in vec.rows.collect())
    b = sorted((r["row_id"], r["y"]) for r in vec.rows.collect())
    assert a == b and len({x for x, _ in a}) == 3


def test_repeated_ids_do_not_mix_lists(spark):
    df = spark.createDataFrame([(1, "x|y", 1.0), (1, "z", 2.0), (None, "y", 3.0), (None, None, 4.0), (2, "", 5.0)],
                               "id long, tags string, y double")
    vec = standard_vectorize(df, [List("tags", sep="|"), Target("y")], row_id="id")
    got = {r["y"]: [(e["feature_id"], e["value"]) for e in r["features"]] for r in vec.rows.collect()}
    # the tokens are '', x, y, z
    assert got == {1.0: [(1, 0.5), (2, 0.5)], 2.0: [(3, 1.0)], 3.0: [(2, 1.0)], 4.0: [], 5.0: [(0, 1.0)]}


def test_learned_dictionary_encodes_other_data(spark):
    specs = [Identity("cat"), List("tags", sep="|"), Number("num"), Target("y")]
    a = spark.createDataFrame([(1, "a", "x|y", 1.0, 0.0), (2, "b", "y", 2.0, 0.0)],
                              "id long, cat string, tags string, num double, y double")
    vec = standard_vectorize(a, specs, row_id="id")
    again = {r["row_id"]: r["features"] for r in vec.encode(a).collect()}
    assert again == {r["row_id"]: r["features"] for r in vec.rows.collect()}
    b = spark.createDataFrame([(7, "c", "y|q", 3.0), (8, None, "x", 1.0)], "id long, cat string, tags string, num double")
    got = {r["row_id"]: [(e["feature_id"], e["value"]) for e in r["features"]]
           for r in vec.encode(b, unseen="skip").collect()}
    assert got == {7: [(3, 0.5), (4, 3.0)], 8: [(2, 1.0), (4, 1.0)]}        # no target column is needed
    with pytest.raises(Exception, match="unseen token"):
        vec.encode(b, unseen="error").collect()
    with pytest.raises(ValueError):
        vec.encode(b, unseen="guess")


def test_time_takes_a_transform(spark):
    df = spark.createDataFrame([(1, 7200, 0.0)], "id long, ts long, y double")
    vec = standard_vectorize(df, [Time("ts", transform=lambda c: c / 3600.0), Target("y")], row_id="id")
    assert rows_of(vec)[1][1] == [(0, 2.0)]


def test_broadcasts_are_bounded_in_sum(spark):
    from fmlattice.operators.vectorize import within_budget
    sides = {0: (10, 100), 1: (10, 50), 2: (10, 5000)}
    assert within_budget(spark, sides, budget=2000) == {0, 1}
    assert within_budget(spark, sides, budget=700) == {1}


def test_null_and_hot_tokens_over_the_broadcast_bound(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"t{i}", "u|v", 0.0)
                                for i in range(90)], "id long, c string, l string, y double")
    specs = [Identity("c"), List("l", sep="|"), Target("y")]
    small = rows_of(standard_vectorize(df, specs, row_id="id"))
    spark.conf.set("fmlattice.broadcastBytes", "1")
    try:
        assert rows_of(standard_vectorize(df, specs, row_id="id")) == small
    finally:
        spark.conf.unset("fmlattice.broadcastBytes")


def grown(spark):
    from fmlattice.operators.fields import Identity, List, Number, Target
    old = spark.createDataFrame([(1, "b", "x|y", 1.0, 0.5), (2, "d", "y", 2.0, 0.1)], "id long, c string, l string, n double, y double")
    new = spark.createDataFrame([(3, "a", "z|x", 3.0, 0.2), (4, "b", "y|y|w", 0.0, 0.3), (5, None, "", 1.0, 0.4)],
                                "id long, c string, l string, n double, y double")
    return standard_vectorize(old, [Identity("c"), List("l", sep="|"), Number("n"), Target("y")], row_id="id"), old, new


def entries(rows):
    return {r["row_id"]: [(e["feature_id"], e["value"]) for e in r["features"]] for r in rows.collect()}


def test_extended_dictionaries_keep_old_ids(spark, tmp_path):
    vec, old, new = grown(spark)
    # c: b d | l: x y | n; then c: a, l: '' w z
    more = vec.extend(new)
    assert more.dimension == 9 and [(b.name, b.offset, b.size) for b in more.blocks()] == [
        ("c", 0, 2), ("c+1", 5, 1), ("l", 2, 2), ("l+1", 6, 3), ("n", 4, 1)]
    assert entries(more.rows) == {3: [(5, 1.0), (2, 0.5), (8, 0.5), (4, 3.0)], 4: [(0, 1.0), (3, 1 / 3), (7, 1 / 3)],
                                  5: [(6, 1.0), (4, 1.0)]}
    assert entries(more.encode(old)) == entries(vec.rows)
    again = more.extend(spark.createDataFrame([(9, "zz", "x", 1.0, 0.0)], old.schema))
    assert again.dimension == 10 and entries(again.rows)[9] == [(9, 1.0), (2, 1.0), (4, 1.0)]
    assert again.extend(old).dimension == 10
    assert more.dictionary.count() == 8


def test_saved_dictionaries_and_models(spark, tmp_path):
    from fmlattice.operators import model as M
    from fmlattice.operators.vectorize import Learned
    vec, old, new = grown(spark)
    more = vec.extend(new)
    more.learned.save(str(tmp_path / "dict"))
    back = Learned.load(spark, str(tmp_path / "dict"), [0, 1])
    assert (back.sizes, back.nbytes, back.version, back.first) == (more.learned.sizes, more.learned.nbytes, 1, more.learned.first)
    assert entries(vec.encoder(new, "error", back)) == entries(more.rows)
    cfg = M.FMConfig(k=2, init_stdev=0.1, seed=4)
    model = M.FMModel(0.5, M.init_params(spark, vec.dimension, cfg), cfg, vec.dimension)
    model.save(str(tmp_path / "model"))
    loaded = M.FMModel.load(spark, str(tmp_path / "model"))
    assert (loaded.w0, loaded.cfg, loaded.dimension) == (0.5, cfg, vec.dimension)
    assert loaded.params.orderBy("feature_id").collect() == model.params.orderBy("feature_id").collect()
    wide = loaded.grown(more.dimension)
    assert wide.params.count() == more.dimension
    assert wide.params.where(F.col("feature_id") < vec.dimension).orderBy("feature_id").collect() == \
        model.params.orderBy("feature_id").collect()


def test_arrow_functions_as_transforms(spark):
    """One Python evaluation in the plan; a null number has no entry."""
    from fmlattice.operators.fields import Number, Target
    from fmlattice.plans.catalog import arrow_log1p
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 0.0), (3, 0.0, 0.0)], "id long, n double, y double")
    vec = standard_vectorize(df, [Number("n", transform=arrow_log1p()), Target("y")], row_id="id")
    plan = vec.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert entries(vec.rows) == {1: [(0, 0.6931471805599453)], 2: [], 3: []}
