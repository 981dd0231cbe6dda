import random

import corpus_pipeline as CP
from fmlattice.llm.common import table
from fmlattice.llm.language_id import predict, train
from fmlattice.llm.secret_scan import BASE_RULES, MORE_RULES
from tests.llm.test_exact_dedup import norm
from tests.llm.test_ngram_join import brute
from tests.llm.test_secret_scan import brute as secrets_in

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in CP.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "secrets", "best_fit"]


def test_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    und = {r["doc_id"] for r in predict(docs, train(docs)).where("lang_pred = 'und'").collect()}
    left = {i: t for i, t in rows.items() if i not in und}
    first = {}
    for i in sorted(left):
        first.setdefault(norm(left[i]), i)
    left = {i: left[i] for i in first.values()}
    left = {c: left[c] for c in {c for c, _ in brute(sorted(left.items())).values()}}

    def clean(t):
        cover = [False] * len(t)
        for _, a, b in secrets_in(t, BASE_RULES + MORE_RULES):
            cover[a:b] = [True] * (b - a)
        out, i = "", 0
        spans = sorted((a, b) for _, a, b in secrets_in(t, BASE_RULES + MORE_RULES))
        merged = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            out += t[i:a] + "[SECRET]"
            i = b
        return out + t[i:]

    import re
    want = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", clean(t)) if w]) + 1 for i, t in left.items()}
    got = {}
    for r in CP.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == want


def test_odd_documents(spark):
    r = random.Random(1)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda: " ".join(r.choice("the of and ing her tion".split()) for _ in range(40))
    rows = [(i, words(), "en", "s", 10) for i in range(0, 30)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "12 34", "en", "s", 5), (None, words(), None, "s", 1),
             (5, rows[5][1], "en", "s", 10), rows[6], rows[6], (103, "the of " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    n = None
    for name, stage in CP.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit":
            assert out.columns == docs.columns
            assert n is None or out.count() <= n
            n = out.count()
        docs = out
    assert {g["doc_id"] for g in docs.collect()} >= {103}
    empty = spark.createDataFrame([], schema)
    for _, stage in CP.STAGES:
        assert stage(spark, empty, SF).count() == 0
