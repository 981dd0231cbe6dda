import pytest

from fmlattice.operators.fields import Identity, List, Number, Target
from fmlattice.operators.relations import Relation, encode_relation, relation_vectorize


def fact_and_side(spark):
    fact = spark.createDataFrame([(1, 10, "p", 1.0), (2, 11, "q", 2.0), (3, 12, "p", 3.0)],
                                 "id long, uid long, kind string, y double")
    side = spark.createDataFrame([(10, "m", 2.0), (11, "f", 0.5)], "uid long, g string, age double")
    return fact, side


def test_match_replaces_key_and_miss_falls_back(spark):
    fact, side = fact_and_side(spark)
    rel = Relation(side, [Target("uid"), Identity("g"), Number("age")])
    vec = relation_vectorize(fact, [Identity("uid"), Identity("kind"), Target("y")], {"uid": rel},
                             row_id="id")
    # key block 3 ids (10, 11, 12), relation block 3 (g: f, m; age), kind 2
    assert [(b.name, b.offset, b.size) for b in vec.blocks()] == \
        [("uid", 0, 3), ("g", 3, 2), ("age", 5, 1), ("kind", 6, 2)]
    got = {r["row_id"]: [(e["feature_id"], e["value"]) for e in r["features"]] for r in vec.rows.collect()}
    assert got[1] == [(4, 1.0), (5, 2.0), (6, 1.0)]     # m, age 2, kind p
    assert got[2] == [(3, 1.0), (5, 0.5), (7, 1.0)]     # f, age .5, kind q
    assert got[3] == [(2, 1.0), (6, 1.0)]               # miss: own one-hot of key 12
    keep = relation_vectorize(fact, [Identity("uid"), Identity("kind"), Target("y")], {"uid": rel},
                              row_id="id", keep_key=True)
    got = {r["row_id"]: [e["feature_id"] for e in r["features"]] for r in keep.rows.collect()}
    assert got[1] == [0, 4, 5, 6]


def test_duplicate_side_keys(spark):
    side = spark.createDataFrame([(10, "m"), (10, "f")], "uid long, g string")
    with pytest.raises(ValueError):
        encode_relation(Relation(side, [Target("uid"), Identity("g")]))
    enc = encode_relation(Relation(side, [Target("uid"), Identity("g")], on_duplicate="first", order_by="g"))
    assert enc.size == 1
    with pytest.raises(ValueError):
        encode_relation(Relation(side, [Target("uid"), Identity("g")], on_duplicate="first"))


def test_assigned_row_ids_with_a_relation(spark):
    fact, side = fact_and_side(spark)
    rel = Relation(side, [Target("uid"), Identity("g"), Number("age")])
    vec = relation_vectorize(fact.drop("id"), [Identity("uid"), Identity("kind"), Target("y")], {"uid": rel})
    got = sorted((r["y"], [e["feature_id"] for e in r["features"]]) for r in vec.rows.collect())
    assert got == [(1.0, [4, 5, 6]), (2.0, [3, 5, 7]), (3.0, [2, 6])]
    assert vec.rows.select("row_id").distinct().count() == 3


def test_first_duplicate_is_the_least_row(spark):
    side = spark.createDataFrame([(10, "m", 2), (10, "f", 1), (10, "a", 1), (11, "z", 5)], "uid long, g string, o int")
    enc = encode_relation(Relation(side, [Target("uid"), Identity("g")], on_duplicate="first", order_by="o"))
    assert {r["token"] for r in enc.vec.dictionary.collect()} == {"a", "z"}


def test_learned_relation_encodes_other_facts(spark):
    fact, side = fact_and_side(spark)
    rel = Relation(side, [Target("uid"), Identity("g"), Number("age")])
    vec = relation_vectorize(fact, [Identity("uid"), Identity("kind"), Target("y")], {"uid": rel}, row_id="id")
    other = spark.createDataFrame([(9, 11, "p"), (8, 99, "q")], "id long, uid long, kind string")
    got = {r["row_id"]: [e["feature_id"] for e in r["features"]] for r in vec.encode(other, unseen="skip").collect()}
    assert got == {9: [3, 5, 6], 8: [7]}


def chain(spark):
    fact = spark.createDataFrame([(i, i % 7 if i % 5 else None, float(i)) for i in range(40)], "id long, sup long, y double")
    sup = spark.createDataFrame([(0, "n0", 1.0), (1, "n1", 2.0), (2, "n9", 3.0), (3, None, 4.0), (4, "n0", 0.0)],
                                "sup long, nation string, bal double")
    nation = spark.createDataFrame([("n0", 0), ("n1", 1), ("n2", 0)], "nation string, region int")
    region = spark.createDataFrame([(0, "R|S")], "region int, names string")
    r = Relation(region, [Target("region"), List("names", sep="|")])
    n = Relation(nation, [Target("nation"), Identity("region")], relations={"region": r})
    return fact, Relation(sup, [Target("sup"), Identity("nation"), Number("bal")], relations={"nation": n})


def test_chain_of_side_tables(spark):
    """Each level's key gives way to the row it points to; misses at any level keep it."""
    fact, rel = chain(spark)
    vec = relation_vectorize(fact, [Identity("sup"), Target("y")], {"sup": rel}, row_id="id")
    # fact keys 0..6 | nations n0 n1 n9 | regions 0 1 | names R S | bal
    assert [(b.offset, b.size) for b in vec.blocks()] == [(0, 7), (7, 3), (10, 2), (12, 2), (14, 1)]
    got = {r["row_id"]: {(e["feature_id"], e["value"]) for e in r["features"]} for r in vec.rows.collect()}
    of = {0: {(12, 0.5), (13, 0.5), (14, 1.0)}, 1: {(11, 1.0), (14, 2.0)}, 2: {(9, 1.0), (14, 3.0)}, 3: {(14, 4.0)},
          4: {(12, 0.5), (13, 0.5)}, 5: {(5, 1.0)}, 6: {(6, 1.0)}}
    for i in range(40):
        assert got[i] == (of[i % 7] if i % 5 else set()), i


def test_relational_learning_over_a_chain(spark):
    from fmlattice.operators import als as A
    from fmlattice.operators import model as M
    from fmlattice.operators import relational as RL
    from fmlattice.operators.blocks import conflict_free_blocks
    fact, rel = chain(spark)
    specs = [Identity("sup"), Target("y")]
    cfg = M.FMConfig(k=1, iterations=1, init_stdev=0.2, seed=4, regv=0.5, regw=0.5)
    flat = relation_vectorize(fact, specs, {"sup": rel}, row_id="id")
    params = M.init_params(spark, flat.dimension, cfg)
    a = A.als_iteration(A.prepare(flat.rows, conflict_free_blocks(flat.rows, flat.blocks())), params, 0.0, cfg, flat.dimension)
    data = RL.relational_dataset(fact, specs, {"sup": rel}, row_id="id")
    b = RL.relational_iteration(RL.prepare_relational(data), params, 0.0, cfg)
    x, y = (p.params.orderBy("feature_id").toPandas() for p in (a, b))
    assert abs(x.w - y.w).max() < 1e-9 and abs(x.v0 - y.v0).max() < 1e-9
