import numpy as np

from fmlattice.operators import als as A
from fmlattice.operators import model as M
from fmlattice.operators import relational as RL
from fmlattice.operators.blocks import conflict_free_blocks
from fmlattice.operators.fields import Identity, List, Number, Target
from fmlattice.operators.relations import Relation, relation_vectorize


def star(spark, seed=7):
    rng = np.random.default_rng(seed)
    fact = [(i, int(rng.integers(0, 12)), f"p{rng.integers(0, 3)}", float(rng.normal()))
            for i in range(150)]
    side = [(u, f"g{u % 3}", "|".join(rng.choice(list("abcd"), size=rng.integers(1, 3))), float(rng.normal()))
            for u in range(10)]        # keys 10, 11 have no side row: misses
    f = spark.createDataFrame(fact, "id long, uid long, kind string, y double")
    s = spark.createDataFrame(side, "uid long, g string, tags string, age double")
    rel = Relation(s, [Target("uid"), Identity("g"), List("tags", sep="|"), Number("age")])
    return f, rel


def test_relational_pass_equals_flat_pass(spark):
    fact, rel = star(spark)
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=2, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    flat = relation_vectorize(fact, specs, {"uid": rel}, row_id="id")
    data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")
    assert data.dimension == flat.dimension
    params = M.init_params(spark, flat.dimension, cfg)
    blocks = conflict_free_blocks(flat.rows, flat.blocks())
    a = A.als_iteration(A.prepare(flat.rows, blocks), params, 0.0, cfg, flat.dimension)
    assert any(b.size < 4 for rb in data.relations for b in rb.blocks)   # the list was cut
    b = RL.relational_iteration(RL.prepare_relational(data), params, 0.0, cfg)
    pa = a.params.orderBy("feature_id").toPandas()
    pb = b.params.orderBy("feature_id").toPandas()
    assert abs(a.w0 - b.w0) < 1e-12 and abs(a.rmse_before - b.rmse_before) < 1e-12
    for c in ("w", "v0", "v1"):
        assert np.abs(pa[c].values - pb[c].values).max() < 1e-10, c


def test_side_tables_by_caches_and_by_joined_columns_are_the_same(spark):
    """The same pass with the side table's blocks solved with the fact's, solved on its own
    rows a segment at a time, and a block at a time."""
    fact, rel = star(spark, seed=11)
    plain = Relation(rel.table, [Target("uid"), Identity("g"), Number("age")])
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=2, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    for relation, cells, kinds in ((plain, "65536", ["list"]), (rel, "65536", ["list", "SideTable", "list"]),
                                   (plain, "1", ["list", "SideTable", "list"])):
        flat = relation_vectorize(fact, specs, {"uid": relation}, row_id="id")
        params = M.init_params(spark, flat.dimension, cfg)
        want = A.als_iteration(A.prepare(flat.rows, conflict_free_blocks(flat.rows, flat.blocks())), params, 0.0, cfg,
                               flat.dimension).params.orderBy("feature_id").toPandas()
        spark.conf.set("fmlattice.gramCells", cells)
        try:
            train = RL.prepare_relational(RL.relational_dataset(fact, specs, {"uid": relation}, row_id="id"))
            assert [type(s).__name__ for s in train.steps] == kinds
            got = RL.relational_iteration(train, params, 0.0, cfg).params.orderBy("feature_id").toPandas()
        finally:
            spark.conf.unset("fmlattice.gramCells")
        for c in ("w", "v0", "v1"):
            assert np.abs(want[c].values - got[c].values).max() < 1e-10, (cells, c)


def test_fit_facade_takes_relational_data(spark):
    fact, rel = star(spark, seed=2)
    data = RL.relational_dataset(fact, [Identity("uid"), Identity("kind"), Target("y")], {"uid": rel},
                                 row_id="id")
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.1, seed=1, regv=1.0)
    model = A.fit(data, cfg)
    assert model.params.count() == data.dimension
    assert [r["iteration"] for r in model.trace.collect()] == [1]


def test_over_the_bounds_the_relational_pass_is_the_same(spark):
    fact, rel = star(spark, seed=9)
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=2, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")
    params = M.init_params(spark, data.dimension, cfg)
    a = RL.relational_iteration(RL.prepare_relational(data), params, 0.0, cfg).params.orderBy("feature_id").toPandas()
    for name, value in (("literalBlockRows", "0"), ("broadcastRows", "0"), ("segmentBlocks", "2")):
        spark.conf.set(f"fmlattice.{name}", value)
    try:
        data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")
        b = RL.relational_iteration(RL.prepare_relational(data), params, 0.0, cfg).params.orderBy("feature_id").toPandas()
    finally:
        for name in ("literalBlockRows", "broadcastRows", "segmentBlocks"):
            spark.conf.unset(f"fmlattice.{name}")
    for c in ("w", "v0", "v1"):
        assert np.abs(a[c].values - b[c].values).max() < 1e-9, c


def test_keys_match_alike_on_both_paths(spark):
    fact = spark.createDataFrame([(1, "07", 1.0), (2, "8", 2.0), (3, "9", 3.0), (4, "abc", 4.0), (5, None, 5.0)],
                                 "id long, uid string, y double")
    side = spark.createDataFrame([(7, "m"), (8, "f")], "uid long, g string")
    rel = Relation(side, [Target("uid"), Identity("g")])
    specs = [Identity("uid"), Target("y")]
    flat = relation_vectorize(fact, specs, {"uid": rel}, row_id="id")
    data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")
    matched = {r["row_id"] for r in flat.rows.collect() if any(e["feature_id"] >= 4 for e in r["features"])}
    assert matched == {2} == {r["row_id"] for r in data.fact.where("key_0 IS NOT NULL").collect()}


def test_learner_argument_and_scratch(spark):
    """The given learner is used; only the parameters stay in the scratch folder."""
    import os

    from fmlattice.session import Scratch
    fact, rel = star(spark, seed=3)
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")
    calls = []

    def learner(train, params, w0, cfg, dimension):
        calls.append(dimension)
        return RL.relational_iteration(train, params, w0, cfg, dimension)

    cfg = M.FMConfig(k=1, iterations=2, init_stdev=0.1, seed=1, regv=1.0)
    scratch = Scratch(spark, "kept")
    A.fit(data, cfg, learner=learner, scratch=scratch)
    assert calls == [data.dimension] * 2
    assert len(scratch.paths) == 1 and "params" in scratch.paths[0] and not scratch.tables
    folder = os.path.dirname(scratch.paths[0]).removeprefix("file:")
    assert not any(n.startswith(("rows-", "rstate-", "cache-", "segment-", "sums-", "side-")) and "kept" in n
                   for n in os.listdir(folder))


def test_hot_side_key(spark):
    """A third of all facts hold one key, a third none."""
    rng = np.random.default_rng(5)
    fact = [(i, 0 if i % 3 == 0 else None if i % 3 == 1 else int(rng.integers(1, 9)), f"p{i % 4}", float(rng.normal()))
            for i in range(180)]
    f = spark.createDataFrame(fact, "id long, uid long, kind string, y double")
    s = spark.createDataFrame([(u, f"g{u % 3}") for u in range(9)], "uid long, g string")
    rel = Relation(s, [Target("uid"), Identity("g")])
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.2, seed=4, regv=0.5)
    flat = relation_vectorize(f, specs, {"uid": rel}, row_id="id")
    params = M.init_params(spark, flat.dimension, cfg)
    blocks = conflict_free_blocks(flat.rows, flat.blocks())
    a = A.als_iteration(A.prepare(flat.rows, blocks), params, 0.0, cfg, flat.dimension).params
    data = RL.relational_dataset(f, specs, {"uid": rel}, row_id="id")
    b = RL.relational_iteration(RL.prepare_relational(data), params, 0.0, cfg).params
    a, b = (x.orderBy("feature_id").toPandas() for x in (a, b))
    assert np.abs(a.w.values - b.w.values).max() < 1e-10 and np.abs(a.v0.values - b.v0.values).max() < 1e-10


def test_strengths_by_group(spark):
    """By all three ways of a side table; one group of the model's strength is no change."""
    fact, rel = star(spark, seed=6)
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    data = RL.relational_dataset(fact, specs, {"uid": rel}, row_id="id")

    def fitted(**kw):
        return A.fit(data, cfg, **kw).params.orderBy("feature_id").toPandas()

    plain = fitted()
    same = fitted(group_reg={g: (cfg.regw, cfg.regv) for g in range(5)})
    assert np.abs(plain.values - same.values).max() < 1e-12 and list(plain.columns) == list(same.columns)
    reg = {1: (3.0, 4.0), 2: (0.0, 9.0), 4: (1.0, 0.25)}
    got = fitted(group_reg=reg)
    assert np.abs(got.w - plain.w).max() > 1e-3
    for name, value in (("gramCells", "1"), ("literalBlockRows", "0")):
        spark.conf.set(f"fmlattice.{name}", value)
        try:
            other = fitted(group_reg=reg)
        finally:
            spark.conf.unset(f"fmlattice.{name}")
        assert np.abs(got.values - other.values).max() < 1e-9, name


def test_one_segment_table_is_all_a_pass_reads(spark):
    """Few blocks and joining side tables: rows are not placed, and a pass writes one state;
    a side table above the broadcast bound is joined once by a shuffle, hot and null keys
    included.  A wide block (the key's own) and repeated or null row ids are no matter."""
    from fmlattice.session import Scratch
    rng = np.random.default_rng(8)
    fact = [(None if i % 7 == 0 else i // 2, 0 if i % 3 == 0 else None if i % 3 == 1 else int(rng.integers(1, 14)), f"p{i % 4}",
             float(rng.normal())) for i in range(240)]
    f = spark.createDataFrame(fact, "id long, uid long, kind string, y double")
    s = spark.createDataFrame([(u, f"g{u % 3}", float(rng.normal())) for u in range(9)], "uid long, g string, age double")
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    rel = {"uid": Relation(s, [Target("uid"), Identity("g"), Number("age")])}
    cfg = M.FMConfig(k=2, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    flat = relation_vectorize(f, specs, rel, row_id="id")
    want = A.fit(flat.rows, cfg, flat.dimension, conflict_free_blocks(flat.rows, flat.blocks()))
    for conf in ({"literalBlockRows": "12"}, {"literalBlockRows": "12", "broadcastRows": "0"}):
        for name, value in conf.items():
            spark.conf.set(f"fmlattice.{name}", value)
        try:
            data = RL.relational_dataset(f, specs, rel, row_id="id")
            scratch = Scratch(spark, "one")
            train = RL.prepare_relational(data, scratch)
            assert train.table is not None and [type(x).__name__ for x in train.steps] == ["list"]
            assert train.segments()[0].wide(spark) and not any("rows-" in p for p in scratch.paths)
            start, sums = RL.relational_start(train, M.init_params(spark, data.dimension, cfg), 0.0, cfg)
            assert sums == {} and start.state.count() == 240
            got = A.fit(data, cfg)
        finally:
            for name in conf:
                spark.conf.unset(f"fmlattice.{name}")
        assert abs(got.w0 - want.w0) < 1e-10
        assert np.abs(np.array([r[1] for r in sorted(got.trace.collect())]) -
                      np.array([r[1] for r in sorted(want.trace.collect())])).max() < 1e-10
        a, b = (m.params.orderBy("feature_id").toPandas() for m in (got, want))
        assert np.abs(a.values - b.values).max() < 1e-9, conf


def test_states_written_within_a_pass(spark):
    """With one segment table the changes wait, a wide block's too; the same result where
    they may not."""
    from fmlattice.session import Scratch
    fact, rel = star(spark, seed=12)
    plain = Relation(rel.table, [Target("uid"), Identity("g"), Number("age")])
    specs = [Identity("uid"), Identity("kind"), Target("y")]
    cfg = M.FMConfig(k=2, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.1)
    written, got = [], []

    class Counted(Scratch):
        def write(self, df, name=None):
            written.append(name)
            return super().write(df, name)

    for rows in ("2000000", "13"):          # of 12 ids, one wide block's changes at a time
        spark.conf.set("fmlattice.literalBlockRows", "11")
        spark.conf.set("fmlattice.broadcastRows", rows)
        try:
            data = RL.relational_dataset(fact, specs, {"uid": plain}, row_id="id")
            train = RL.prepare_relational(data, Counted(spark, "counted"))
            written.clear()
            got.append(RL.relational_iteration(train, M.init_params(spark, data.dimension, cfg), 0.0, cfg)
                       .params.orderBy("feature_id").toPandas())
        finally:
            spark.conf.unset("fmlattice.literalBlockRows")
            spark.conf.unset("fmlattice.broadcastRows")
        assert written.count("state") == (0 if rows == "2000000" else 1)
    assert np.abs(got[0].values - got[1].values).max() < 1e-10
