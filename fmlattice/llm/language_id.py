"""Language identification by prediction by partial matching.

For each language a context tree of variable order holds how often each byte
followed each context of up to ``ORDER`` bytes.  A byte is coded in the longest
context the tree has; an escape (probability: distinct symbols over occurrences
plus distinct symbols) passes to the next shorter one, whose symbols already
excluded are left out, down to all 256 bytes alike.  So each context yields an
exact distribution, and the sum of -log2 over a text is its code length under
that language.  The statistics are frozen after training: a text's length does
not depend on the texts before it.

Only what was seen is stored: for each language its (context, byte) pairs with
their code lengths and its contexts with their escapes', sorted, so the memory
follows the trained bytes.  The distinct pairs of a piece of text are looked up
with numpy, one language after the other.  Training uses a bounded sample of labelled rows (``SAMPLE_*``), drawn by
a hash of the id; scoring is a scan without shuffle.

A text is *identified* if the trees code it about as well as texts of its language: a
fifth of the sample is kept aside from the trees, and a text whose code length exceeds
``REJECT_FACTOR`` times the median length of those, byte for byte, by more than
``REJECT_BITS`` is in no learned language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches

ORDER = 3
SAMPLE_DOCS = 400               # labelled rows for each language
SAMPLE_BYTES = 1 << 20          # and their bytes in sum
SAMPLE_ALL_DOCS = 100_000       # of all languages; many languages have fewer each
SAMPLE_ALL_BYTES = 1 << 28
SAMPLE_TEXT_BYTES = 1 << 16     # of a longer text a stretch from its first letter on is drawn
MIN_CONTEXT = 4                 # a context is in the tree if it occurs so often in some language
SEGMENT = 1 << 18               # bytes scored at a time
ASIDE = 5                       # every fifth text of the sample measures what is usual
REJECT_FACTOR = 3.5
REJECT_BITS = 64.0              # what a short text may take besides


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class ContextTrees:
    """Frozen statistics of all languages, sparse.

    ``trees[lang][k]``: codes of the grams of k + 1 bytes, their bits, codes of the
    contexts of k bytes, and the bits of their escapes."""

    def __init__(self, langs: list[str], samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = langs, order
        used = np.zeros(256, bool)
        for lang in langs:
            for t in samples[lang]:
                used[np.frombuffer(t, np.uint8)] = True
        seen = np.flatnonzero(used)
        self.symbols = len(seen) + 1                    # the last one: any byte not in the sample
        self.symbol_of = np.full(256, len(seen), np.int64)
        self.symbol_of[seen] = np.arange(len(seen))
        self.base = self.symbols + 1                    # symbol ``symbols`` is the text's start
        # a context often enough in some language is in the tree of all
        self.contexts = [np.zeros(0, np.int64) for _ in range(order + 1)]
        for lang in langs:
            for k, (grams, n) in enumerate(self._counts(samples[lang])):
                ctx, inverse = np.unique(grams // self.base, return_inverse=True)
                often = ctx if k == 0 else ctx[np.bincount(inverse, n, len(ctx)) >= MIN_CONTEXT]
                self.contexts[k] = np.union1d(self.contexts[k], often)
        self.trees = [self._tree(self._counts(samples[lang])) for lang in langs]

    def _counts(self, texts: list[bytes]):
        """(gram codes, n) for contexts of 0, 1, .. bytes."""
        s = self._padded(texts)
        real = np.flatnonzero(s < self.symbols)
        ok = np.ones(len(real), bool)
        code = s[real].copy()
        out = []
        for k in range(self.order + 1):
            if k:                                       # put the byte k places before in front
                older = s[real - k]
                ok &= older < self.symbols
                code = code + older * self.base ** k
            out.append(np.unique(code[ok], return_counts=True))
        return out

    def _tree(self, counts):
        tree, shorter = [], None
        for k, (grams, n) in enumerate(counts):
            keep = found(self.contexts[k], grams // self.base)[1]
            grams, n = grams[keep], n[keep]
            ctx, of = np.unique(grams // self.base, return_inverse=True)
            times, distinct = np.bincount(of, n, len(ctx)), np.bincount(of, minlength=len(ctx))
            # what the seen bytes leave to the others in the next shorter context, which saw them too
            below = 1 / 256 if k == 0 else shorter[1][found(shorter[0], grams % self.base ** k)[0]]
            rest = np.where(distinct < 256, 1 - np.bincount(of, np.broadcast_to(below, len(of)), len(ctx)), 0.0)
            p = n / (times + distinct * (rest > 0))[of]
            with np.errstate(divide="ignore"):
                escape = -np.log2(distinct / (times + distinct)) + np.log2(rest)
            tree.append((grams, -np.log2(p).astype(np.float32), ctx, escape.astype(np.float32)))
            shorter = grams, p
        return tree

    def _padded(self, texts: list[bytes]) -> np.ndarray:
        gap = np.full(self.order, self.symbols, np.int64)
        parts = [gap]
        for t in texts:
            parts += [self.symbol_of[np.frombuffer(t, np.uint8)], gap]
        return np.concatenate(parts)

    def _bits(self, tree, grams: np.ndarray) -> np.ndarray:
        """Bits of the last bytes of grams of ``order`` + 1 symbols in one language."""
        out = np.zeros(len(grams), np.float32)
        todo = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            codes, bits, contexts, escapes = tree[k]
            mine = grams[todo] % self.base ** (k + 1)
            at, ok = found(codes, mine)
            out[todo[ok]] += bits[at[ok]]
            todo, mine = todo[~ok], mine[~ok]
            at, ok = found(contexts, mine // self.base)
            out[todo[ok]] += escapes[at[ok]]            # a context it never saw costs nothing
        out[todo] += 8                                  # below order 0 all 256 bytes are alike
        return out

    @property
    def rows(self) -> int:
        return sum(map(len, self.contexts))

    @property
    def bits(self) -> np.ndarray:
        """The distributions in full, (contexts x symbols, languages), for checks."""
        front = [np.full(self.order - k, self.symbols, np.int64) @ self.base ** np.arange(k, self.order)
                 if k < self.order else 0 for k in range(self.order + 1)]
        ctx = np.concatenate([c + f for c, f in zip(self.contexts, front)])
        grams = (ctx[:, None] * self.base + np.arange(self.symbols)).ravel()
        return np.stack([self._bits(tree, grams) for tree in self.trees], 1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language: float64 (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), SEGMENT):
                pieces.append((t[max(0, a - self.order):a], t[a:a + SEGMENT]))
                owner.append(i)
                size += len(pieces[-1][1])
                if size >= SEGMENT:
                    self._add(pieces, owner, out)
                    pieces, owner, size = [], [], 0
        if pieces:
            self._add(pieces, owner, out)
        return out

    def _add(self, pieces, owner, out) -> None:
        d, n_sym = self.order, self.symbols
        lengths = np.array([len(p) for _, p in pieces])
        ends = np.cumsum(lengths + d)
        s = np.full(int(ends[-1]), n_sym, np.int64)
        scored = np.ones(len(s), bool)
        for (before, piece), end in zip(pieces, ends.tolist()):
            a = end - len(piece)
            s[a:end] = self.symbol_of[np.frombuffer(piece, np.uint8)]
            if before:
                s[a - len(before):a] = self.symbol_of[np.frombuffer(before, np.uint8)]
            scored[a - d:a] = False
        at = np.flatnonzero(scored)
        code = s[at].copy()
        for k in range(1, d + 1):
            code += s[at - k] * self.base ** k
        grams, inverse = np.unique(code, return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        who = np.array(owner)
        for j, tree in enumerate(self.trees):
            bits = self._bits(tree, grams)[inverse]
            np.add.at(out[:, j], who, np.add.reduceat(bits, starts, dtype=np.float64))


def found(codes: np.ndarray, wanted: np.ndarray):
    """(place, whether it is there) of each of ``wanted`` in sorted ``codes``."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def sampled(docs: DataFrame) -> dict[str, list[bytes]]:
    """The training texts of each language of ``docs`` (text, lang, doc_id): of the rows with
    a label, a text with a letter, and an id that is not held out, the first ones by a
    hash of the id, so many that all of them are within ``SAMPLE_*``.

    Exact counts bound the draw before any window sorts rows: about four times the rows
    wanted of a language are looked at (more if that was too few)."""
    spark = docs.sparkSession
    usable = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                          F.col("text").cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
        .withColumn("key", F.struct(F.xxhash64(F.lit("sample"), "doc_id").alias("draw"), "doc_id",
                                    F.xxhash64("text").alias("of"))))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .limit(SAMPLE_ALL_DOCS + 1).collect()}
    if not counts:
        return {}
    if len(counts) > SAMPLE_ALL_DOCS:
        raise ValueError(f"more than {SAMPLE_ALL_DOCS} different labels: these are no languages")
    each, each_bytes = min(SAMPLE_DOCS, SAMPLE_ALL_DOCS // len(counts)), min(SAMPLE_BYTES, SAMPLE_ALL_BYTES // len(counts))
    # the first rows of each language by its keys alone, then their texts
    by_key = Window.partitionBy("lang").orderBy("key")
    share = {lang: min(1.0, 4 * each / n) for lang, n in counts.items()}
    while True:
        limits = spark.createDataFrame([(lang, min((1 << 63) - 1, int(p * 2.0 ** 64) - (1 << 63))) for lang, p in share.items()],
                                       "lang string, most long")
        near = usable.select("lang", "key").join(F.broadcast(limits), "lang").where("key.draw <= most")
        last = {r["lang"]: r for r in near.withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= each)
                .groupBy("lang").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).collect()}
        short = [x for x, n in counts.items() if share[x] < 1 and (last[x]["n"] if x in last else 0) < min(each, n)]
        if not short:
            break
        share |= {x: min(1.0, 4 * share[x]) for x in short}
    ends = spark.createDataFrame([(x, *r["last"]) for x, r in last.items()], "lang string, draw long, doc_id long, of long") \
        .select("lang", F.struct("draw", "doc_id", "of").alias("last"))
    stretch = F.regexp_extract("text", f"(?s)\\p{{L}}.{{0,{SAMPLE_TEXT_BYTES // 4 - 1}}}", 0)
    drawn = (usable.join(F.broadcast(ends), "lang").where(F.col("key") <= F.col("last"))
             .withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= each)
             .select("lang", "place", F.when(F.octet_length("text") <= SAMPLE_TEXT_BYTES, F.col("text"))
                     .otherwise(stretch).alias("text")))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("place")) - F.octet_length("text")
    drawn = drawn.withColumn("before", so_far).where(F.col("before") < each_bytes).drop("before")
    samples: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["place"])):
        mine = samples.setdefault(r["lang"], [])
        data = r["text"].encode("utf-8")
        if used.get(r["lang"], 0) + len(data) <= each_bytes:
            mine.append(data)
            used[r["lang"]] = used.get(r["lang"], 0) + len(data)
    return {x: t for x, t in samples.items() if t}


def train(docs: DataFrame) -> ContextTrees | None:
    """Context trees of the languages of ``docs`` (text, lang, doc_id), from ``sampled`` rows.
    None if there is no such row."""
    samples = sampled(docs)
    return ContextTrees(sorted(samples), samples) if samples else None


class Identifier:
    """Trees, and for each language the bits per byte beyond which a text is not in it."""

    def __init__(self, samples: dict[str, list[bytes]]):
        aside = {x: t[ASIDE - 1::ASIDE] for x, t in samples.items()}
        rest = {x: [b for i, b in enumerate(t) if i % ASIDE != ASIDE - 1] for x, t in samples.items()}
        self.trees = ContextTrees(sorted(samples), rest)
        usual = {}
        for j, x in enumerate(self.trees.langs):
            if aside[x]:
                bits = self.trees.code_lengths(aside[x])[:, j]
                usual[x] = float(np.median(bits / np.array([len(b) for b in aside[x]])))
        most = max(usual.values(), default=8.0)         # too few texts: as the hardest language
        self.bound = {x: REJECT_FACTOR * usual.get(x, most) for x in self.trees.langs}

    def identified(self, texts: list[str | None]) -> list[bool]:
        pred, _, rate = label(self.trees, texts)
        sizes = [len(t.encode("utf-8")) if t else 0 for t in texts]
        return [p != "und" and r * n <= self.bound[p] * n + REJECT_BITS for p, r, n in zip(pred, rate.tolist(), sizes)]


def identifier(docs: DataFrame) -> Identifier | None:
    samples = sampled(docs)
    return Identifier(samples) if samples else None


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def label(trees: ContextTrees | None, texts: list[str | None]):
    """(language, score, bits per byte) of each text."""
    live = [i for i, t in enumerate(texts) if trees and lettered(t)]
    pred, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if live:
        data = [texts[i].encode("utf-8") for i in live]
        bits = trees.code_lengths(data)
        least = bits.min(1, keepdims=True)
        score[live] = 1 / np.exp2(-np.minimum(bits - least, 1000)).sum(1)
        rate[live] = least[:, 0] / np.array([len(d) for d in data])
        for i, j in zip(live, bits.argmin(1).tolist()):
            pred[i] = trees.langs[j]
    return pred, score, rate


def predict(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, bits_per_byte.

    ``score`` is the share of the chosen language in the sum of 2^-bits over all
    languages.  Null, empty and letterless texts, and all texts if nothing was
    learned, are ``und`` with score 0.  Equal code lengths go to the name that
    sorts first.  Repeated rows are each returned; other columns are ignored; an
    empty table gives no row."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_batches(batches, 1):
            pred, score, rate = label(frozen.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                      ).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with the columns of ``docs``.

    Null, empty and letterless texts go, and those whose code length in the nearest
    language is beyond its bound (``Identifier``): gibberish, and languages that were
    not learned.  If nothing was learned, all texts with a letter stay."""
    frozen = docs.sparkSession.sparkContext.broadcast(identifier(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in text_batches(batches, at):
            texts = batch.column(at).to_pylist()
            keep = frozen.value.identified(texts) if frozen.value else [lettered(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
