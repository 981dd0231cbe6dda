import random

import numpy as np

from fmlattice.llm.topk_mtree import Subtree, bulk_load, lifted, top_k
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, ids string, query_id int"


def brute(rows, k=20):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
            if i is not None and v is not None and len(v) and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)): (i, v) for i, v in good}.values():
        if i % 20 == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(frame, rows, **kw):
    df = frame([(i, v, 0, "", "", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, **kw).collect()))


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(5, d))
    return [(i, [float(x) for x in (c[i % 5] + r.normal(size=d) * 0.2).astype(np.float32)]) for i in range(n)]


def test_against_brute_force(frame):
    for n, d, size in ((300, 8, 40), (150, 3, 4096), (10, 4, 4)):
        rows = clustered(n, d, n)
        assert run(frame, rows, subtree=size) == brute(rows)


def test_hot_vector_ties_and_bad_rows(frame):
    r = random.Random(1)
    rows = [(i, [1.0, 0.5, 0.0] if i % 3 == 0 else [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(240)]
    rows += [(1000, None), (1020, [1.0, None, 2.0]), (1040, [float("nan"), 1.0, 1.0]), (1060, [float("inf"), 0.0, 0.0]),
             (None, [1.0, 1.0, 1.0]), (1080, []), (-40, [-0.001, -2.5, 3.0])]
    assert run(frame, rows, subtree=16) == brute(rows)


def test_zero_repeats_and_empty(frame):
    rows = [(0, [0.0, 0.0]), (20, [0.0, 0.0]), (3, [0.0, 0.0])]
    assert run(frame, rows) == brute(rows)
    # every row is a candidate, a repeated one too; equal query rows ask once
    more = rows + [(20, [0.0, 0.0]), (3, [0.0, 0.0])]
    assert run(frame, more) == brute(more)
    assert [x[2] for x in run(frame, more) if x[0] == 0] == [3, 3, 20, 20]
    assert run(frame, []) == [] and run(frame, [(1, [1.0])]) == [] and run(frame, [(20, [1.0])]) == []
    assert run(frame, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])]) == [(0, 1, 1, 64 * 64 + 128 * 128)]


def test_lengths_are_apart_and_rows_count_singly(frame):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(-3, 3, 2 + i % 3)]) for i in range(200)]
    rows += [rows[i] for i in (0, 20, 20, 41, 41, 41)] + [(999, [1.0, 1.0])] * 30 + [(40, [9.0])]
    for size in (16, 4096):
        assert run(frame, rows, subtree=size) == brute(rows)


def test_large_components_raise_or_are_exact(frame):
    import pytest
    rows = [(0, [1e5, 3.0]), (1, [1e5, -2.0]), (2, [-1e5, 0.25])]
    assert run(frame, rows) == brute(rows)
    with pytest.raises(ValueError, match="squared length"):
        run(frame, rows + [(3, [1e18, 0.0])])


def test_query_id_on_many_near_vectors(frame):
    r = np.random.default_rng(7)
    rows = [(20, [float(100 + i), float(i % 7)]) for i in range(90)]        # the largest products
    rows += [(40 if i % 3 == 0 else 1000 + i, [float(x) for x in r.integers(-9, 9, 2)]) for i in range(180)]
    rows = list({(i, tuple(v)): (i, v) for i, v in rows}.values())
    for size in (16, 4096):
        got = run(frame, rows, subtree=size)
        assert got == brute(rows)
        assert len([g for g in got if g[0] == 20]) == 90 * 20


def test_pages_cover_and_bounds_avoid_work():
    r = np.random.default_rng(3)
    x = np.concatenate([np.floor(r.normal(size=(400, 4)) * 5 + c) for c in (0, 300, -300)])
    x = np.unique(x, axis=0)
    m2 = float((x * x).sum(1).max())
    a = lifted(x, m2)
    pages = bulk_load(x, a, page=32)
    seen = np.concatenate([p["members"] for p in pages if p["leaf"]])
    assert sorted(seen.tolist()) == list(range(len(x)))
    rows = [{"page": i, "leaf": p["leaf"], "radius": p["radius"], "center": x[p["center"]].astype("<i8").tobytes(),
             "member_distance": p["member_distance"].astype("<f8").tobytes(),
             "members": x[p["members"]].astype("<i8").tobytes() if p["leaf"] else p["members"].astype("<i8").tobytes(),
             "ids": [[int(m)] for m in p["members"]] if p["leaf"] else []} for i, p in enumerate(pages)]
    tree = Subtree(rows, m2)
    q = x[::97]
    who, loss, ids, computed = tree.search(q, np.full(len(q), -1), 5, np.full(len(q), -np.inf))
    for n, v in enumerate(q):
        want = sorted((-int(v @ c), i) for i, c in enumerate(x))[:5]
        assert list(zip(loss[who == n].tolist(), ids[who == n].tolist())) == want
    # queries near the origin have no near candidates; the others skip most pages
    assert computed.mean() < 0.6 * len(x), computed


def test_share_of_distances_computed(frame):
    """In clusters most distances are avoided; the measure is part of the result."""
    r = np.random.default_rng(6)
    c = r.normal(size=(8, 16)) * 40
    rows = [(i, [float(v) for v in c[i % 8] + r.normal(size=16)]) for i in range(2000)]
    df = frame([(i, v, 0, "", "", 1) for i, v in rows], SCHEMA)
    got = top_k(df, with_work=True, subtree=128).groupBy("query_id").agg({"computed": "max", "candidates": "max"}).collect()
    assert all(g["max(candidates)"] == 2000 for g in got)
    assert np.mean([g["max(computed)"] for g in got]) < 0.6 * 2000
