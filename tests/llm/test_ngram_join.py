import random
import re

import numpy as np
import pytest

from fmlattice.llm import ngram_join
from fmlattice.llm.common import mix, table
from fmlattice.llm.components import components
from fmlattice.llm.ngram_join import choose_bands, gram_hashes, jaccard_join, one_of_each, shared_counts
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "doc_id long, text string, bands string, node long"


def grams(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (class_id, n_links) for unique ids."""
    sets = {i: grams(t) for i, t in rows}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[i] = (min(seen), len(links[i]))
    return out


def corpus(seed=0, bases=6, copies=12):
    r = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(r.choice([8, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_bands_reach_the_recall():
    bands, rows = choose_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 160


def test_bands_that_cannot_reach_the_recall_raise():
    assert choose_bands(0.1)[0] >= 88
    with pytest.raises(ValueError, match="max_hashes"):
        choose_bands(0.05)
    bands, rows = choose_bands(0.05, max_hashes=400)
    assert 1 - (1 - 0.05 ** rows) ** bands >= 0.9999
    for bad in (0, 1.2):
        with pytest.raises(ValueError):
            choose_bands(bad)


def test_gram_hashes_do_not_cross_texts():
    texts = ["a b c d e f", "", "g", " a  b\tc d e", "x y", "\xe9 a b c d e"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(d) for d in data])
    hashes, starts = gram_hashes(np.frombuffer(b"".join(data), np.uint8), offsets, 5)
    alone = [gram_hashes(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 5)[0] for d in data]
    assert [len(a) for a in alone] == [len(grams(t)) for t in texts]
    for i, a in enumerate(alone):
        assert (hashes[starts[i]:starts[i + 1]] == a).all()
    assert alone[0][0] == alone[3][0]


def test_shared_counts():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(300), r.randint(0, 90))), np.uint64) for _ in range(20)]
    got = shared_counts(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


@pytest.mark.parametrize("block_rows", [256, 3])
def test_against_all_pairs(frame, block_rows):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "two one")]
    df = frame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(df, block_rows=block_rows).collect()}
    assert got == brute(rows)
    stay = {r["doc_id"] for r in one_of_each(df).collect()}
    assert stay == {c for c, _ in brute(rows).values()}


def test_hot_group(frame):
    """A third of all texts are near copies of one text, all different."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        w[r.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}_{j}" for j in range(20))) for i in range(180)]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join(frame(rows, "doc_id long, text string"),
                                                                           block_rows=16).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_large_buckets_at_every_distance(frame, seed):
    """Families whose members lie within half the distance of a pivot, between that and the
    threshold, and beyond it, with equal sets among them; blocks of three rows."""
    r = random.Random(seed)
    rows = []
    for size, family, edits in ((120, 40, [0, 1, 1]), (120, 40, [1, 2, 3]), (60, 30, [0, 1, 2, 4]), (300, 30, [1, 5, 9])):
        base = [f"b{r.randrange(10**6)}" for _ in range(size)]
        for _ in range(family):
            w = list(base)
            for _ in range(r.choice(edits)):
                w[r.randrange(size)] = f"n{r.randrange(12)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    for block_rows, block_grams in ((3, 400_000), (256, 900)):
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in
               jaccard_join(frame(rows, "doc_id long, text string"), block_rows=block_rows, block_grams=block_grams).collect()}
        assert got == brute(rows)


def test_bucket_of_many_near_copies_is_linear(frame, monkeypatch):
    """20,000 different texts, all pairs of them links: a set is not sent once for every
    block of its buckets."""
    many = 20_000
    sent = []
    group = ngram_join.laid_out

    def counted(*args):
        out = group(*args)
        sent.append(out.selectExpr("coalesce(sum(size(others)), 0) AS n").first()["n"])
        return out

    monkeypatch.setattr(ngram_join, "laid_out", counted)
    texts = frame([(0,)], "z int").selectExpr(f"explode(sequence(0, {many - 1})) AS i").selectExpr(
        "CAST(i AS long) AS doc_id", "concat_ws(' ', transform(sequence(0, 199), j -> IF(j = (i * 7) % 200, "
        "concat('n', i), concat('w', j)))) AS text")
    got = jaccard_join(texts)
    bad = got.where(f"class_id <> 0 OR n_links <> {many - 1}")
    assert got.count() == many and bad.count() == 0
    assert len(sent) == 1 and sent[0] <= 24 * many


def test_repeated_rows_and_null_ids(frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u v"), (None, "k l m n o p")]
    df = frame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in jaccard_join(df).collect())
    assert got == [(-1, -1, 0), (-1, 1, 2), (1, 1, 2), (1, 1, 2), (7, 7, 0)]
    assert sorted(r["doc_id"] or -1 for r in one_of_each(df).collect()) == [-1, 1, 7]
    assert jaccard_join(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_long_text_and_planted_copies(spark, frame):
    r = random.Random(8)
    long = [str(r.randrange(10**6)) for _ in range(60_000)]
    near = list(long)
    for i in range(0, 60_000, 600):
        near[i] = "x"
    got = {x["doc_id"]: x["class_id"] for x in jaccard_join(frame([(2, " ".join(long)), (1, " ".join(near)), (3, "z")],
                                                                  "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_recall_on_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_components(frame):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randrange(40), 1000 + r.randrange(40)) for _ in range(30)]
    edges += [(5000, 5000 + i) for i in range(1, 60)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["root"] for x in components(frame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(frame([], "a long, b long")).count() == 0
    assert mix(np.array([1], np.uint64))[0] != 1
