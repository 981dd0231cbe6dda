import random

import numpy as np

from pyspark.sql import functions as F

from fmlattice.llm.language_id import ContextTrees, keep_identified, predict, train
from fmlattice.llm.common import table
from tests.llm.frames import frame  # noqa: F401

WORDS = {"aa": "the of and ing tion her wh".split(), "bb": "der die und sch ung ein ö".split(), "cc": "que les é ou eau".split()}


def docs(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join("".join(r.choices(WORDS[lang], k=2)) for _ in range(30)), lang, "s", 0))
    return out


def slow_bits(samples, text, order, trees):
    """PPM with exclusion by dictionaries: bits of one text under one language."""
    counts = {}
    for t in samples:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    c = counts.setdefault(t[i - k:i], {})
                    c[t[i]] = c.get(t[i], 0) + 1

    def prob(ctx, s):
        """Distribution in a context: dict symbol -> probability over all 256 bytes."""
        below = prob(ctx[1:], None) if ctx else {b: 1 / 256 for b in range(256)}
        have = counts.get(ctx, {})
        if not have:
            return below
        rest = sum(p for b, p in below.items() if b not in have)
        n, d = sum(have.values()), len(have)
        return {b: have[b] / (n + d) if b in have else d / (n + d) * p / rest for b, p in below.items()}

    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            ctx = text[i - k:i]
            if k == 0 or ctx in trees:
                total -= np.log2(prob(ctx, None)[text[i]])
                break
    return total


def test_code_lengths_are_exact():
    samples = {"aa": [b"abracadabra", b"banana band"], "bb": [b"xyzzy xyz abra"]}
    model = ContextTrees(["aa", "bb"], samples, order=2)
    import fmlattice.llm.language_id as L
    known = set()                       # contexts in the tree: often enough in some language
    for lang in samples:
        n = {}
        for t in samples[lang]:
            for i in range(len(t)):
                for k in (1, 2):
                    if i >= k:
                        n[t[i - k:i]] = n.get(t[i - k:i], 0) + 1
        known |= {c for c, m in n.items() if m >= L.MIN_CONTEXT}
    for text in (b"abra", b"banana", b"\x00\xffq ab", b"x", b"dabdab xyz"):
        got = model.code_lengths([text])[0]
        want = [slow_bits(samples[x], text, 2, known) for x in ("aa", "bb")]
        assert np.allclose(got, want, rtol=1e-5), (text, got, want)


def test_probabilities_sum_to_one():
    model = ContextTrees(["aa"], {"aa": [b"the cat sat on the mat that the cat ate"]})
    p = np.exp2(-model.bits.astype(float)).reshape(model.rows, model.symbols)
    size = np.ones(model.symbols)
    size[-1] = 256 - (model.symbols - 1)
    assert np.allclose(p @ size, 1, atol=1e-4)


def test_many_languages_keep_their_contexts():
    r = random.Random(2)
    samples = {}
    for i in range(40):                 # 40 languages, each with 24 of 200 symbols: above 6 M dense cells
        own = bytes(r.sample(range(32, 232), 24))
        samples[f"l{i:02}"] = [bytes(r.choices(own, k=60)) for _ in range(60)]
    model = ContextTrees(sorted(samples), samples)
    often = set()                       # contexts of up to 3 bytes seen MIN_CONTEXT (4) times in some language
    for texts in samples.values():
        n = {}
        for t in texts:
            for i in range(len(t)):
                for k in range(1, min(3, i) + 1):
                    n[t[i - k:i]] = n.get(t[i - k:i], 0) + 1
        often |= {c for c, m in n.items() if m >= 4}
    assert model.rows == len(often) + 1 and model.rows * model.symbols * 40 > 6_000_000
    for lang in ("l00", "l39"):
        text = samples[lang][0]
        assert np.isclose(model.code_lengths([text])[0][model.langs.index(lang)],
                          slow_bits(samples[lang], text, 3, often), rtol=1e-5)


def test_segments_do_not_change_a_text(monkeypatch):
    import fmlattice.llm.language_id as L
    model = ContextTrees(["aa"], {"aa": [b"hello world hello there"]})
    text = b"hello there world " * 50
    whole = model.code_lengths([text, b"x"])
    monkeypatch.setattr(L, "SEGMENT", 7)
    assert np.allclose(model.code_lengths([text, b"x"]), whole, rtol=1e-5)


def test_held_out_accuracy_and_odd_rows(frame):
    rows = docs(150) + [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "123 !?", "bb", "s", 0),
                        (None, "die und der", None, "s", 0), (1003, "the of and " * 20_000, None, None, None)]
    df = frame(rows, "doc_id long, text string, lang string, source string, score long")
    got = {r["doc_id"]: r for r in predict(df, train(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:150])
    assert any(got[i]["held_out"] for i in range(150))
    for i in (1000, 1001, 1002):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[1003]["lang_pred"] == "aa" and got[None]["held_out"] is False
    kept = keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_every_language_with_a_usable_row_is_learned(frame):
    rows = docs(60)
    rows += [(100 + i, "zyx wvu " * 10_000, "long", "s", 0) for i in range(6)]          # above 64 KiB each
    rows += [(2000 + i, "12 34" if i % 500 else "que qua quo", "few", "s", 0) for i in range(3000)]
    rows += [(9, "der und die", "hot", "s", 0) for i in range(5000)]
    df = frame(rows, "doc_id long, text string, lang string, source string, n long")
    model = train(df)
    assert model.langs == ["aa", "bb", "cc", "few", "hot", "long"]
    assert predict(df.where("doc_id = 100"), model).first()["lang_pred"] == "long"


def test_held_out_rows_do_not_train(frame):
    from zlib import crc32
    out = [r for r in docs(60) if crc32(str(r[0]).encode()) % 3 == 1]
    df = frame(out, "doc_id long, text string, lang string, source string, n long")
    assert train(df) is None
    assert {r["lang_pred"] for r in predict(df, None).collect()} == {"und"}
    assert predict(df.limit(0), train(df.limit(0))).count() == 0


def test_lettered_rows_stay_if_nothing_was_learned(frame):
    df = frame([(1, "the of", None, "s", 0), (2, "12", None, "s", 0), (3, None, None, "s", 0)],
               "doc_id long, text string, lang string, source string, n long")
    assert train(df) is None and [r["doc_id"] for r in keep_identified(df).collect()] == [1]


def test_accuracy_on_the_tables(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    got = predict(df, train(df)).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95


STRANGE = ["Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt. Se kertoo pitkästä talvesta ja lyhyestä kesästä, "
           "jolloin yö ei tule lainkaan.", "これは日本語の文章です。モデルはこれを見たことがありません。" * 3,
           "Это русский текст, которого модель никогда не видела, и он должен быть отвергнут.", "qxj zvkw " * 40, "0a" * 200]


def test_gibberish_and_unlearned_languages_go(spark):
    """And nothing else: the tables' documents are in learned languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = spark.createDataFrame([(10**9 + i, t, "fi", "s", 1) for i, t in enumerate(STRANGE)],
                                    "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang", F.lit(None).cast("string"))
    both = docs.unionByName(strange)
    kept = {r["doc_id"] for r in keep_identified(both).select("doc_id").collect()}
    with_letter = {r["doc_id"] for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert kept == with_letter


def test_labels_decide_what_stays(spark):
    """With one language's labels only, that language's documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = docs.withColumn("lang", F.when(F.col("lang") == "de", "de"))
    other = spark.createDataFrame([(10**9, STRANGE[2], None, "s", 1)], docs.schema)
    kept = keep_identified(some.unionByName(other)).join(docs.select("doc_id", F.col("lang").alias("is")), "doc_id").collect()
    left = [r["is"] for r in kept]
    assert left.count("de") == docs.where("lang = 'de'").count() and 10**9 not in {r["doc_id"] for r in kept}


def test_many_labels_share_the_sample(frame, monkeypatch):
    from fmlattice.llm import language_id as L
    rows = [(i, f"text number {i} about {'abc'[i % 3] * 5}", f"l{i % 40}") for i in range(400)]
    df = frame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "SAMPLE_ALL_DOCS", 80)
    samples = L.sampled(df)
    assert 0 < max(map(len, samples.values())) <= 2
    monkeypatch.setattr(L, "SAMPLE_ALL_DOCS", 20)
    import pytest
    with pytest.raises(ValueError, match="no languages"):
        L.sampled(df)


def test_draw_by_share_is_the_draw_by_order(frame, monkeypatch):
    """The bounded draw takes the first rows by key, whatever share it begins with."""
    from fmlattice.llm import language_id as L
    rows = [(i // 2, f"text {i}", "a" if i % 10 else "b") for i in range(600)]
    df = frame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "SAMPLE_DOCS", 7)
    got = L.sampled(df)
    key = df.select("lang", "text", L.held_out(F.col("doc_id")).alias("h"),
                    F.struct(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", F.xxhash64("text")).alias("k")).where("not h")
    for lang in "ab":
        want = [r["text"].encode() for r in key.where(F.col("lang") == lang).orderBy("k").limit(7).collect()]
        assert got[lang] == want
