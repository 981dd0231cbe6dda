"""The run solver against the sequential sweep, and the number of jobs of a pass."""
import numpy as np
import pytest

import seq_fm
from fmlattice.operators import als as A
from fmlattice.operators import gram
from fmlattice.operators import model as M
from fmlattice.operators.blocks import conflict_free_blocks
from fmlattice.operators.fields import Identity, List, Number, Target
from fmlattice.operators.vectorize import Block, standard_vectorize


def fitted(vec, cfg, spark):
    pdf = vec.rows.orderBy("row_id").toPandas()
    rows = [(np.array([e["feature_id"] for e in f], dtype=int), np.array([e["value"] for e in f])) for f in pdf.features]
    p0 = M.init_params(spark, vec.dimension, cfg).orderBy("feature_id").toPandas()
    w, v, w0 = p0.w.values.copy(), np.vstack([p0[f"v{f}"].values for f in range(cfg.k)]), 0.0
    for _ in range(cfg.iterations):
        w0, w, v, _ = seq_fm.iteration(rows, pdf.y.values, w0, w, v, cfg.reg0, cfg.regw, cfg.regv)
    return w0, w, v


def data(spark, n=200, seed=4):
    r = np.random.default_rng(seed)
    rows = [(i, f"a{r.integers(0, 5)}" if r.random() < .9 else None, f"b{r.integers(0, 3)}", float(r.normal()),
             float(r.integers(0, 3)) * 50, float(r.normal()), "|".join(r.choice(list("pqrs"), r.integers(1, 3))), float(r.normal()))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, a string, b string, n1 double, n2 double, n3 double, l string, y double")


@pytest.mark.parametrize("fields", [
    [Identity("a"), Identity("b"), Number("n1"), Number("n2")],                 # one run, two varying values
    [Number("n1"), Number("n2"), Identity("a"), Number("n3")],                  # a third one starts another run
    [Identity("a"), List("l", sep="|"), Number("n2")],                          # weights vary within a block
])
def test_runs_equal_the_sequential_sweep(spark, fields):
    vec = standard_vectorize(data(spark), [*fields, Target("y")], row_id="id")
    cfg = M.FMConfig(k=2, iterations=2, init_stdev=0.2, seed=5, regv=0.7, regw=0.1)
    model = A.fit(vec.rows, cfg, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks()))
    p = model.params.orderBy("feature_id").toPandas()
    w0, w, v = fitted(vec, cfg, spark)
    assert abs(model.w0 - w0) < 1e-10 and np.abs(p.w.values - w).max() < 1e-9
    for f in range(cfg.k):
        assert np.abs(p[f"v{f}"].values - v[f]).max() < 1e-9


def test_runs_are_cut_by_cells_and_varying_values():
    blocks = [Block("a", 0, 99), Block("b", 99, 9), Block("c", 108, 5000), Block("d", 5108, 1), Block("e", 5109, 1), Block("f", 5110, 1)]
    one = [1.0, 1.0, 1.0, None, None, None]
    assert gram.runs(blocks, one, 4096, 1000) == [[0, 1], [2], [3, 4], [5]]
    assert gram.runs(blocks, one, 4096, 999) == [[0], [1], [2], [3, 4], [5]]
    assert gram.runs(blocks[:2], [1.0, 1.0], 4096, 0) == [[0], [1]]


def jobs_of(spark, action):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_pass(spark):
    """One job for each segment and family beside a constant (adaptive execution would count
    every shuffle of a query as a job of its own)."""
    df = data(spark)
    counts = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for k in (1, 4):
        for name, fields in (("one", [Identity("a"), Identity("b"), Number("n1")]),
                             ("three", [Number("n1"), Number("n2"), Identity("a"), Number("n3"), Identity("b"), Number("id")])):
            vec = standard_vectorize(df, [*fields, Target("y")], row_id="id")
            cfg = M.FMConfig(k=k, iterations=1, init_stdev=0.1, seed=5, regv=1.0)
            train = A.prepare(vec.rows, conflict_free_blocks(vec.rows, vec.blocks()))
            params = M.init_params(spark, vec.dimension, cfg)
            n = len(train.segments)
            counts[k, n] = jobs_of(spark, lambda: A.als_iteration(train, params, 0.0, cfg, vec.dimension))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    constant = counts[1, 1] - 2
    assert set(counts) == {(1, 1), (4, 1), (1, 2), (4, 2)} and constant < 20
    for (k, n), jobs in counts.items():
        written = (1 + k) * n // A.PENDING * 2      # the state, after so many changes
        assert jobs <= (1 + k) * n + constant + written, counts


def test_state_is_written_after_some_changes(spark, monkeypatch):
    monkeypatch.setattr(A, "PENDING", 2)
    monkeypatch.setattr(A, "KEPT_VALUES", 1)
    vec = standard_vectorize(data(spark), [Identity("a"), Identity("b"), Number("n1"), Target("y")], row_id="id")
    cfg = M.FMConfig(k=3, iterations=1, init_stdev=0.2, seed=5, regv=0.7, regw=0.1)
    spark.conf.set("fmlattice.gramCells", "1")
    try:
        p = A.fit(vec.rows, cfg, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks())).params.orderBy("feature_id").toPandas()
    finally:
        spark.conf.unset("fmlattice.gramCells")
    _, w, v = fitted(vec, cfg, spark)
    assert np.abs(p.w.values - w).max() < 1e-9
    assert all(np.abs(p[f"v{f}"].values - v[f]).max() < 1e-9 for f in range(3))
