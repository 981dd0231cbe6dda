import numpy as np

import seq_fm
from fmlattice.operators import als as A
from fmlattice.operators import model as M
from fmlattice.operators.blocks import conflict_free_blocks, libfm_blocks
from fmlattice.operators.fields import Identity, List, Number, Target
from fmlattice.operators.vectorize import standard_vectorize


def synthetic(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    toks = list("abcdefgh")
    data = []
    for i in range(n):
        tags = "|".join(rng.choice(toks, size=rng.integers(1, 4)))
        data.append((i, f"c{rng.integers(0, 6)}", tags, float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(data, "id long, cat string, tags string, num double, y double")
    return standard_vectorize(df, [Identity("cat"), List("tags", sep="|"), Number("num"), Target("y")],
                              row_id="id")


def numpy_fit(vec, cfg, spark):
    pdf = vec.rows.orderBy("row_id").toPandas()
    rows = [(np.array([e["feature_id"] for e in f], dtype=int), np.array([e["value"] for e in f]))
            for f in pdf.features]
    p0 = M.init_params(spark, vec.dimension, cfg).orderBy("feature_id").toPandas()
    w = p0.w.values.copy()
    v = np.vstack([p0[f"v{f}"].values for f in range(cfg.k)])
    w0, trace = 0.0, []
    for _ in range(cfg.iterations):
        w0, w, v, r = seq_fm.iteration(rows, pdf.y.values, w0, w, v, cfg.reg0, cfg.regw, cfg.regv)
        trace.append(r)
    return w0, w, v, trace


def test_block_sweep_equals_sequential_sweep_with_lists(spark):
    vec = synthetic(spark)
    cfg = M.FMConfig(k=2, iterations=2, init_stdev=0.1, seed=5, regv=1.0, regw=0.1)
    blocks = conflict_free_blocks(vec.rows, vec.blocks())
    assert len(blocks) > 3            # the list field was cut into several blocks
    model = A.fit(vec.rows, cfg, vec.dimension, blocks)
    p = model.params.orderBy("feature_id").toPandas()
    w0, w, v, trace = numpy_fit(vec, cfg, spark)
    assert abs(model.w0 - w0) < 1e-12
    assert np.abs(p.w.values - w).max() < 1e-10
    for f in range(cfg.k):
        assert np.abs(p[f"v{f}"].values - v[f]).max() < 1e-10
    got = [r["rmse"] for r in model.trace.orderBy("iteration").collect()]
    assert np.allclose(got, trace, atol=1e-12)


def test_libfm_style_blocks_without_fields(spark):
    vec = synthetic(spark, n=120, seed=3)
    blocks = libfm_blocks(vec.rows, vec.dimension)
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=2, regv=1.0)
    model = A.fit(vec.rows, cfg, vec.dimension, blocks)
    p = model.params.orderBy("feature_id").toPandas()
    _, w, v, _ = numpy_fit(vec, cfg, spark)
    assert np.abs(p.w.values - w).max() < 1e-10 and np.abs(p.v0.values - v[0]).max() < 1e-10


def test_zero_sum_hh_with_zero_reg_keeps_value(spark):
    # one feature per row: q = v x, so h = x q - x^2 v = 0 for every v update
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i % 5)) for i in range(30)], "id long, c string, y double")
    vec = standard_vectorize(df, [Identity("c"), Target("y")], row_id="id")
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=1, regv=0.0)
    p0 = M.init_params(spark, vec.dimension, cfg).orderBy("feature_id").toPandas()
    model = A.fit(vec.rows, cfg, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks()))
    p = model.params.orderBy("feature_id").toPandas()
    assert np.array_equal(p.v0.values, p0.v0.values)
    assert np.isfinite(p.w.values).all()


def test_predict_empty_row_and_metrics(spark):
    rows = spark.createDataFrame([(1, 1.0, [(0, 1.0)]), (2, -1.0, []), (3, 0.0, [(9, 2.0)])],
                                 "row_id long, y double, features array<struct<feature_id:bigint,value:double>>")
    params = spark.createDataFrame([(0, 0.5, 0.1)], "feature_id long, w double, v0 double")
    cfg = M.FMConfig(k=1)
    pred = {r["row_id"]: r["prediction"] for r in M.predict(rows, params, 0.25, cfg, 1).collect()}
    assert pred == {1: 0.75, 2: 0.25, 3: 0.25}      # empty row -> w0; unseen id -> 0
    scored = M.predict(rows, params, 0.25, cfg, 1)
    assert abs(M.sign_accuracy(scored).first()[0] - 2 / 3) < 1e-12
    mse = ((1 - 0.75) ** 2 + (-1 - 0.25) ** 2 + 0.25 ** 2) / 3
    assert abs(M.rmse(scored).first()[0] - mse ** 0.5) < 1e-12
    assert abs(M.mean_signed_error(scored).first()[0] - (0.25 - 1.25 - 0.25) / 3) < 1e-12
    assert abs(M.mae(scored).first()[0] - (0.25 + 1.25 + 0.25) / 3) < 1e-12


def test_interaction_formula_equals_pair_sum(spark):
    rows = spark.createDataFrame([(1, 0.0, [(0, 1.0), (1, 2.0), (2, -0.5)])],
                                 "row_id long, y double, features array<struct<feature_id:bigint,value:double>>")
    cfg = M.FMConfig(k=2, init_stdev=0.3, seed=9)
    params = M.init_params(spark, 3, cfg)
    got = M.predict(rows, params, 0.0, cfg, 3, parts="interactions").first()["prediction"]
    p = params.orderBy("feature_id").toPandas()
    x = [1.0, 2.0, -0.5]
    want = sum(sum(p[f"v{f}"][i] * p[f"v{f}"][j] for f in range(2)) * x[i] * x[j]
               for i in range(3) for j in range(i + 1, 3))
    assert abs(got - want) < 1e-14


def test_join_path_for_wide_blocks_gives_the_same_fit(spark):
    vec = synthetic(spark, n=150, seed=11)
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=5, regv=1.0)
    blocks = conflict_free_blocks(vec.rows, vec.blocks())
    a = A.fit(vec.rows, cfg, vec.dimension, blocks).params.orderBy("feature_id").toPandas()
    for bounds in ({"literalBlockRows": "0"}, {"literalBlockRows": "0", "broadcastRows": "0"}, {"segmentBlocks": "1"}):
        for name, value in bounds.items():
            spark.conf.set(f"fmlattice.{name}", value)
        try:
            b = A.fit(vec.rows, cfg, vec.dimension, blocks).params.orderBy("feature_id").toPandas()
        finally:
            for name in bounds:
                spark.conf.unset(f"fmlattice.{name}")
        assert np.abs(a.w.values - b.w.values).max() < 1e-12
        assert np.abs(a.v0.values - b.v0.values).max() < 1e-11


def test_hot_category_with_a_third_of_the_rows(spark):
    rng = np.random.default_rng(21)
    data = [(i, "hot" if i % 3 == 0 else f"c{rng.integers(0, 20)}", f"p{rng.integers(0, 4)}",
             float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(data, "id long, cat string, p string, y double")
    vec = standard_vectorize(df, [Identity("cat"), Identity("p"), Target("y")], row_id="id")
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=8, regv=1.0)
    model = A.fit(vec.rows, cfg, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks()))
    p = model.params.orderBy("feature_id").toPandas()
    _, w, v, _ = numpy_fit(vec, cfg, spark)
    assert np.abs(p.w.values - w).max() < 1e-10 and np.abs(p.v0.values - v[0]).max() < 1e-10


def test_repeated_row_ids(spark):
    """Rows that share an id are rows of their own, in scoring and in training."""
    schema = "row_id long, y double, features array<struct<feature_id:bigint,value:double>>"
    rows = [(1, 1.0, [(0, 1.0)]), (1, 2.0, [(1, 2.0)]), (2, 3.0, [(0, 1.0), (1, 1.0)]), (None, 0.5, [(1, 1.0)])]
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=2, regv=1.0)
    params = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.25, 0.2)], "feature_id long, w double, v0 double")
    got = sorted(r["prediction"] for r in M.predict(spark.createDataFrame(rows, schema), params, 0.0, cfg, 2).collect())
    assert np.allclose(got, sorted([0.5, 0.5, 0.75 + 0.02, 0.25]))
    unique = [(i, y, f) for i, (_, y, f) in enumerate(rows)]
    from fmlattice.operators.vectorize import Block
    blocks = [Block("a", 0, 1), Block("b", 1, 1)]
    a = A.fit(spark.createDataFrame(rows, schema), cfg, 2, blocks).params.orderBy("feature_id").toPandas()
    b = A.fit(spark.createDataFrame(unique, schema), cfg, 2, blocks).params.orderBy("feature_id").toPandas()
    assert np.allclose(a.values, b.values, atol=1e-14)


def test_predict_unseen_features(spark):
    rows = spark.createDataFrame([(1, 1.0, [(9, 1.0)])],
                                 "row_id long, y double, features array<struct<feature_id:bigint,value:double>>")
    params = spark.createDataFrame([(0, 0.5, 0.1)], "feature_id long, w double, v0 double")
    assert M.predict(rows, params, 0.25, M.FMConfig(k=1), 1).first()["prediction"] == 0.25
    import pytest
    with pytest.raises(Exception, match="not in the model"):
        M.predict(rows, params, 0.25, M.FMConfig(k=1), 1, unseen="error").collect()


def test_scratch_after_fit_holds_only_the_parameters(spark):
    from fmlattice.session import Scratch
    vec = synthetic(spark, n=60, seed=2)
    scratch = Scratch(spark, "kept")
    cfg = M.FMConfig(k=2, iterations=2, init_stdev=0.1, seed=5)
    model = A.fit(vec.rows, cfg, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks()), scratch=scratch)
    assert len(scratch.paths) == 1 and "params" in scratch.paths[0] and not scratch.tables
    assert model.params.count() == vec.dimension


def test_many_blocks_by_segments(spark):
    """Every token meets its neighbours, so each is a block of its own; small segments
    give the sequential result."""
    data = [(i, " ".join(f"t{(i + d) % 20:02d}" for d in range(3)), float(i % 7) - 3) for i in range(100)]
    df = spark.createDataFrame(data, "id long, tags string, y double")
    vec = standard_vectorize(df, [List("tags", sep=" "), Target("y")], row_id="id")
    blocks = conflict_free_blocks(vec.rows, vec.blocks())
    assert len(blocks) == 20
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=3, regv=1.0)
    p = A.fit(vec.rows, cfg, vec.dimension, blocks).params.orderBy("feature_id").toPandas()
    _, w, v, _ = numpy_fit(vec, cfg, spark)
    assert np.abs(p.w.values - w).max() < 1e-10 and np.abs(p.v0.values - v[0]).max() < 1e-10


def test_greedy_cut():
    from fmlattice.operators.blocks import greedy_cut
    assert greedy_cut({}, 0, 5) == [(0, 5)]
    assert greedy_cut({1: 0, 2: 1, 3: 2}, 0, 4) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert greedy_cut({4: 0, 5: 3}, 0, 6) == [(0, 4), (4, 6)]


def test_coloured_order(spark):
    """Colour by colour: few blocks, and the sequential result in that order of ids."""
    from fmlattice.operators.blocks import coloured_blocks, relabelled
    from fmlattice.session import Scratch
    data = [(i, " ".join(f"t{(i + d) % 20:02d}" for d in range(3)), f"c{i % 4}", float(i % 7) - 3) for i in range(100)]
    df = spark.createDataFrame(data, "id long, tags string, c string, y double")
    vec = standard_vectorize(df, [List("tags", sep=" "), Identity("c"), Target("y")], row_id="id")
    r = coloured_blocks(vec.rows, vec.blocks(), Scratch(spark, "colour"))
    assert 3 <= len([b for b in r.blocks if "~" in b.name]) <= 8
    new = {x["row_id"]: [e["feature_id"] for e in x["features"]] for x in relabelled(vec.rows, r).collect()}
    for b in r.blocks:
        assert all(sum(b.offset <= i < b.end for i in ids) <= 1 for ids in new.values())
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=3, regv=1.0)
    p = A.fit(vec.rows, cfg, vec.dimension, vec.blocks(), order="coloured").params.orderBy("feature_id").toPandas()
    to = {x["old"]: x["new"] for x in r.mapping.collect()}
    perm = np.array([to.get(i, i) for i in range(vec.dimension)])
    pdf = vec.rows.orderBy("row_id").toPandas()
    rows = [(perm[[e["feature_id"] for e in f]], np.array([e["value"] for e in f])) for f in pdf.features]
    p0 = M.init_params(spark, vec.dimension, cfg).orderBy("feature_id").toPandas()
    w, v = np.zeros(vec.dimension), np.zeros((1, vec.dimension))
    v[0, perm] = p0.v0.values
    _, w, v, _ = seq_fm.iteration(rows, pdf.y.values, 0.0, w, v, 0.0, cfg.regw, cfg.regv)
    assert np.abs(p.w.values - w[perm]).max() < 1e-10 and np.abs(p.v0.values - v[0, perm]).max() < 1e-10
