"""Wide vocabularies: the cut by pointer doubling, colours, the damped step."""
import numpy as np
import pytest

from fmlattice.operators import als as A
from fmlattice.operators import damped
from fmlattice.operators import model as M
from fmlattice.operators.blocks import (adjacent_pairs, colours, conflict_free_blocks, cut_points, greedy_cut)
from fmlattice.operators.fields import Identity, List, Number, Target
from fmlattice.operators.vectorize import Block, standard_vectorize
from fmlattice.session import Scratch

ROWS = "row_id long, y double, features array<struct<feature_id:bigint,value:double>>"


def listed(spark, lists):
    return spark.createDataFrame([(i, 0.0, [(int(x), 1.0) for x in ids]) for i, ids in enumerate(lists)], ROWS)


@pytest.mark.parametrize("bound", [None, "0"])
def test_pointer_doubling_is_the_greedy_cut(spark, bound):
    r = np.random.default_rng(2)
    cases = [[sorted(r.choice(300, 3, replace=False)) for _ in range(40)], [[i, i + 1] for i in range(5, 290)],
             [[0, 299]], [[7]], [[0, b] for b in range(1, 300)], [[a, 299] for a in range(299)]]
    if bound:
        spark.conf.set("fmlattice.broadcastRows", bound)
    try:
        for lists in cases[: 3 if bound else None]:
            rows = listed(spark, lists)
            near = {x["b"]: x["a"] for x in adjacent_pairs(rows, 2, 300).collect()}
            want = [s for s, _ in greedy_cut(near, 2, 300)]
            rounds = []
            assert sorted(x["s"] for x in cut_points(rows, 2, 300, rounds=rounds).collect()) == want
            assert len(rounds) <= np.ceil(np.log2(len(want))) + 1
    finally:
        spark.conf.unset("fmlattice.broadcastRows")


def test_pointers_that_no_chain_needs_leave_the_table(spark, monkeypatch):
    from fmlattice.operators import blocks
    sizes, real = [], blocks.salted_join
    monkeypatch.setattr(blocks, "salted_join", lambda left, right, key, n, how="inner": sizes.append(n) or real(left, right, key, n, how))
    r = np.random.default_rng(4)
    rows = listed(spark, [sorted(r.choice(300, 3, replace=False)) for _ in range(60)])
    cut_points(rows, 0, 300).collect()
    assert sizes[-1] < sizes[0] / 2


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_made_once(spark):
    rows = listed(spark, [[1, 2, 3], [2, 2, 5], [7], []])
    pairs = adjacent_pairs(rows, 0, 8)
    assert plan_of(pairs).count("array_distinct(") == 1
    assert {(x["b"], x["a"]) for x in pairs.collect()} == {(2, 1), (3, 2), (5, 2)}


def test_wide_blocks_are_cut_alike(spark):
    r = np.random.default_rng(3)
    rows = listed(spark, [sorted(r.choice(60, 4, replace=False)) for _ in range(30)])
    want = conflict_free_blocks(rows, [Block("l", 0, 60, True)])
    spark.conf.set("fmlattice.literalBlockRows", "8")
    try:
        assert conflict_free_blocks(rows, [Block("l", 0, 60, True)]) == want
    finally:
        spark.conf.unset("fmlattice.literalBlockRows")


def coloured(spark, lists, hi):
    rounds = []
    got = {x["id"]: x["colour"] for x in colours(listed(spark, lists), 0, hi, Scratch(spark, "c"), rounds).collect()}
    assert sorted(got) == list(range(hi))
    for ids in lists:
        kept = [got[x] for x in set(ids) if x < hi]
        assert len(set(kept)) == len(kept)
    return len(set(got.values())), rounds


def test_colours(spark):
    r = np.random.default_rng(5)
    n, rounds = coloured(spark, [r.choice(500, 4, replace=False).tolist() for _ in range(600)], 510)
    assert n <= 30 and len(rounds) < 40
    assert coloured(spark, [], 5) == (1, [])
    assert coloured(spark, [[1, 1], [2]], 4) == (1, [])


def test_each_id_is_joined_once_in_all_rounds(spark, monkeypatch):
    from fmlattice.operators import blocks
    joined, real = [], blocks.salted_join
    monkeypatch.setattr(blocks, "salted_join", lambda left, right, key, n, how="inner": joined.append(n) or real(left, right, key, n, how))
    r = np.random.default_rng(6)
    lists = [r.choice(300, 4, replace=False).tolist() for _ in range(500)]
    _, rounds = coloured(spark, lists, 300)
    held = len({i for ids in lists for i in ids})
    assert len(rounds) > 4 and sum(joined) <= 2 * held


def test_few_ids_go_through_many_rounds(spark):
    r = np.random.default_rng(8)
    lists = [r.choice(400, 4, replace=False).tolist() for _ in range(3000)]
    n, rounds = coloured(spark, lists, 400)
    assert n <= 90 and sum(rounds) <= 5 * 400


def test_contests_row_by_row(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from fmlattice.operators import blocks
    monkeypatch.setattr(blocks, "PIECE", 50)
    r = np.random.default_rng(9)
    lists = [r.choice(1000, r.integers(1, 9), replace=False).tolist() for _ in range(200)] + [list(range(300))]
    got = {i: i % 150 for i in range(0, 1000, 3)}
    taken = [r.choice(np.arange(150, 200), 3, replace=False).tolist() for _ in lists]
    column = [[got.get(i) for i in ids] for ids in lists]
    given = {"open": pa.array(lists, pa.list_(pa.int64())), "taken": pa.array(taken, pa.list_(pa.int32()))}
    known = SimpleNamespace(value=(np.array(list(got)), np.array(list(got.values()))))
    by_column = pa.record_batch({**given, "colour": pa.array(column, pa.list_(pa.int32()))})
    out = [x for b in blocks.contests(2, 200)(iter([by_column])) for x in b.to_pylist()]
    assert out == [x for b in blocks.contests(2, 200, known)(iter([pa.record_batch(given)])) for x in b.to_pylist()]
    want = [([i for i in ids if i not in got], {*t, *(got[i] for i in ids if i in got)}) for ids, t in zip(lists, taken)]
    want = [w for w in want if w[0]]
    assert [(x["open"], set(x["taken"])) for x in out] == want
    for x in out:
        mine = [{w * blocks.WORD + c for c in range(blocks.WORD) if m >> c & 1} for w, m in zip(x["word"], x["wins"])]
        assert sum(len(m) for m in mine) == len(set().union(*mine))         # a colour has one best
        words = set(x["word"])
        assert set().union(*mine) == {c for c in range(200) if c // blocks.WORD in words} - set(x["taken"])


def test_a_row_of_ten_thousand_ids(spark):
    n, rounds = coloured(spark, [list(range(10_000)), [3, 4], [9_999, 10_001]], 10_002)
    assert 10_000 <= n < 16_000 and len(rounds) < 60


def test_colours_without_broadcasts(spark):
    spark.conf.set("fmlattice.broadcastRows", "0")
    try:
        coloured(spark, [[i, (i * 7 + 1) % 50, 0] for i in range(1, 50)], 50)
    finally:
        spark.conf.unset("fmlattice.broadcastRows")


def parts(spark, seed=3, n=150):
    r = np.random.default_rng(seed)
    rows = [(i, f"a{r.integers(0, 7)}", "|".join(r.choice(list("pqrstu"), r.integers(1, 5))), float(r.normal()), float(r.normal() * 3))
            for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a string, l string, n double, y double")
    return standard_vectorize(df, [Identity("a"), List("l", sep="|"), Number("n"), Target("y")], row_id="id")


def dense_damped(vec, cfg, spark, passes):
    pdf = vec.rows.orderBy("row_id").toPandas()
    x = np.zeros((len(pdf), vec.dimension))
    for i, f in enumerate(pdf.features):
        for e in f:
            x[i, e["feature_id"]] = e["value"]
    y, used = pdf.y.values, (x != 0).any(0)
    p0 = M.init_params(spark, vec.dimension, cfg).orderBy("feature_id").toPandas()
    w0, w, v = 0.0, p0.w.values.copy(), [p0[f"v{f}"].values.copy() for f in range(cfg.k)]

    def predict(w0, w, v):
        return w0 + x @ w + sum(0.5 * ((x @ f) ** 2 - (x * x) @ (f * f)) for f in v)

    rmse = []
    for _ in range(passes):
        e = predict(w0, w, v) - y
        rmse.append(np.sqrt((e * e).mean()))
        new = -(e.sum() - w0 * len(y)) / (cfg.reg0 + len(y))
        e, w0 = e + new - w0, new
        for f in [None, *range(cfg.k)]:
            t, reg = (w, cfg.regw) if f is None else (v[f], cfg.regv)
            h = x if f is None else x * (x @ t)[:, None] - x * x * t
            hh, eh = (h * h).sum(0), (h * e[:, None]).sum(0)
            d = np.where(used & (reg + hh > 0), -(eh - t * hh) / np.where(reg + hh > 0, reg + hh, 1) - t, 0.0)

            def value(s):
                moved = (w + s * d, v) if f is None else (w, [u + s * d if i == f else u for i, u in enumerate(v)])
                err = e + predict(w0, *moved) - predict(w0, w, v)
                return err @ err + reg * ((t + s * d) @ (t + s * d))

            grid = np.linspace(0, 3, 3001)
            best = min(grid, key=value)
            low, high = max(best - 0.001, 0), best + 0.001
            for _ in range(80):
                a, b = low + (high - low) / 3, high - (high - low) / 3
                low, high = (low, b) if value(a) < value(b) else (a, high)
            s = (low + high) / 2
            before = predict(w0, w, v)
            if f is None:
                w = w + s * d
            else:
                v[f] = v[f] + s * d
            e = e + predict(w0, w, v) - before
    return w0, w, v, rmse


def test_damped_fit(spark):
    vec = parts(spark)
    cfg = M.FMConfig(k=2, iterations=3, init_stdev=0.3, seed=5, regv=0.5, regw=0.1)
    model = A.fit(vec.rows, cfg, vec.dimension, order="damped")
    p = model.params.orderBy("feature_id").toPandas()
    w0, w, v, rmse = dense_damped(vec, cfg, spark, cfg.iterations)
    trace = [r["rmse"] for r in model.trace.orderBy("iteration").collect()]
    assert np.allclose(trace, rmse, atol=1e-5) and all(b <= a for a, b in zip(trace, trace[1:]))
    assert abs(model.w0 - w0) < 1e-4 and np.abs(p.w.values - w).max() < 1e-3
    assert all(np.abs(p[f"v{f}"].values - v[f]).max() < 1e-3 for f in range(2))


def test_best_step():
    assert damped.best_step([0.0, 0.0, 0.0, 0.0]) == 0.0
    assert damped.best_step([1.0, 1.0, 0.0, 0.0]) == 0.0            # rises from 0 on
    assert abs(damped.best_step([-2.0, 1.0, 0.0, 0.0]) - 1.0) < 1e-12
    c = [-1.0, -3.0, 0.5, 1.0]
    t = np.linspace(0, 5, 500_001)
    assert abs(damped.best_step(c) - t[np.argmin(sum(x * t ** (i + 1) for i, x in enumerate(c)))]) < 1e-4


def test_max_blocks(spark):
    vec = parts(spark, n=60)
    blocks = conflict_free_blocks(vec.rows, vec.blocks())
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=1, regv=1.0)
    with pytest.raises(ValueError, match="max_blocks=2"):
        A.fit(vec.rows, cfg, vec.dimension, blocks, max_blocks=2)
    with pytest.raises(ValueError, match="max_blocks=2"):
        A.fit(vec.rows, cfg, vec.dimension, vec.blocks(), order="coloured", max_blocks=2)
    assert A.fit(vec.rows, cfg, vec.dimension, blocks, max_blocks=len(blocks)).params.count() == vec.dimension


@pytest.mark.parametrize("ids", [[None] * 6, [1] * 6, [1, 2, 3, 4, 5, None]])
def test_rows_without_ids_of_their_own_are_not_dealt_by_them(spark, monkeypatch, ids):
    dealt, real = [], Scratch.place

    def place(self, df, key, parts, name=None, placed=False):
        if key == "row_id":
            dealt.append([x["row_id"] for x in df.select("row_id").collect()])
        return real(self, df, key, parts, name, placed)

    monkeypatch.setattr(Scratch, "place", place)
    rows = spark.createDataFrame([(i, float(n), [(n, 1.0)]) for n, i in enumerate(ids)], ROWS)
    scratch = Scratch(spark, "ids")
    placed, _ = A.place_rows(rows, scratch)
    assert sorted(x["y"] for x in placed.collect()) == [float(n) for n in range(6)]
    assert all(None not in got and len(set(got)) == 6 for got in dealt)
    scratch.drop_all()
