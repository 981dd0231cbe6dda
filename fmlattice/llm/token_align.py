"""Cross-tokenizer alignment: two tokenizations of a text brought together by bytes.

Both sides' tokens are byte strings whose concatenation is the text, so every token
has a byte range.  For a batch of texts, keyed by document, ``pandas.merge_asof`` finds
for each token start of one side the other side's token that covers it, and the same
the other way round.  The union of both directions is every pair of tokens whose
ranges overlap (the later start of such a pair lies in the other token), which is at
most the sum of the tokens, never their product.  Where both sides end a token at the
same byte, the text is cut into groups; a pair of tokens that ends there is a link.

Tokens do not cross a *unit*: a text is cut before each space between two word or
punctuation characters, where a pre-token of a byte-level vocabulary begins and where
no piece of the other vocabulary (which a side checks when it is loaded) goes on.  So
a worker encodes each distinct unit once, and looks up the others.

Texts are independent, so aligning is a scan.  How often an id pair is linked in the
whole corpus is a sum of each document's distinct pairs, combined before the shuffle.
Counts come back to the documents by a join: broadcast while the exact number of
pairs is small; beyond, the pairs that make up more than a ``HOT_SHARE``-th of all links
(at most ``HOT_SHARE`` of them) are broadcast and the others, none of which is hot,
shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, text_batches, written

TEXT_AT_ONCE = 1 << 20          # bytes of text whose tokens are held at a time
KEPT_UNITS, KEPT_CHARS = 3 << 18, 16 << 20      # of a worker's table, emptied when full
UNIT = re.compile(r" (?=[\w!-~])(?<=[\w!-~] )")
# a unit that begins and ends as UNIT asks, so that it can stand in a row of units
FREE = re.compile(r"[\w!-~](?:.*[\w!-~])?", re.DOTALL).fullmatch
ROW_CHARS = 1 << 16             # units that are encoded in one call
HOT_SHARE = 100_000
SHIFT = 1 << 32                 # an id pair is a * SHIFT + b


def byte_level_alphabet() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others follow from 256 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """What both kinds of sides share: their ids' bytes."""

    pieces: list[bytes]
    by_unit: bool

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces], np.int64)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


class ByteLevelSide(Side):
    """A byte-level BPE file of ``tokenizers``; a text is encoded with a space before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True             # their strings are plain text
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.by_unit = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                        and not before.get("add_prefix_space") and parts.get("normalizer") is None)
        of = byte_level_alphabet()
        names = {i: s for s, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.pieces = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i])
                       else names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(Side):
    """A ``sentencepiece`` model, which puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.by_unit = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
            self.pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8"))
            self.by_unit = self.by_unit and not re.search("[^▁]▁", piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def side(path: str) -> ByteLevelSide | PieceSide:
    return PieceSide(path) if path.endswith(".model") else ByteLevelSide(path)


class Numbered(dict):
    """Places of strings by their first occurrence; ``new`` ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = place = len(self)
        return place


def rows_of(units: list[str], places: list[int]) -> Iterator[list[int]]:
    row, chars = [], 0
    for i in places:
        row.append(i)
        chars += len(units[i]) + 1
        if chars >= ROW_CHARS:
            yield row
            row, chars = [], 0
    if row:
        yield row


def encoded_units(s: ByteLevelSide | PieceSide, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes, whether it is given back) of units.  Free ones are encoded in
    rows, as a text of units is cut into them; a row that is not given back, and other
    units, one by one."""
    starts, sizes, whole = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.ones(len(units), bool)
    flat, n = [], 0
    free = [i for i, u in enumerate(units) if FREE(u)]
    alone = sorted(set(range(len(units))).difference(free))
    for row in rows_of(units, free):
        text = " ".join([units[i] for i in row])
        ids = np.array(s.encode([text])[0], np.int32)
        ends = np.cumsum(s.lengths[ids])
        want = np.cumsum([len(units[i].encode("utf-8")) + 1 for i in row])
        last = np.searchsorted(ends, want)
        if last[-1] + 1 != len(ids) or (ends[last] != want).any() or s.bytes_of(ids) != b" " + text.encode("utf-8"):
            alone += row
            continue
        first = np.r_[0, last[:-1] + 1]
        starts[row], sizes[row] = n + first, last + 1 - first
        flat.append(ids)
        n += len(ids)
    for i, ids in zip(alone, s.encode([units[i] for i in alone]) if alone else ()):
        ids = np.array(ids, np.int32)
        starts[i], sizes[i], whole[i] = n, len(ids), s.bytes_of(ids) == b" " + units[i].encode("utf-8")
        flat.append(ids)
        n += len(ids)
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), starts, sizes, whole


class Units:
    """Both sides' ids of the distinct units met so far, and whether both give the unit back."""

    def __init__(self, sides):
        self.sides = sides
        self.index = Numbered()
        self.chars = 0
        self.whole = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32) for _ in sides]
        self.starts = [np.zeros(0, np.int64) for _ in sides]
        self.sizes = [np.zeros(0, np.int64) for _ in sides]

    def numbers(self, units: list[str]) -> np.ndarray:
        """The place of each unit; those not met before are encoded."""
        places = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        new, self.index.new = self.index.new, []
        if new:
            whole = np.ones(len(new), bool)
            for k, s in enumerate(self.sides):
                ids, starts, sizes, given_back = encoded_units(s, new)
                self.starts[k] = np.r_[self.starts[k], len(self.ids[k]) + starts]
                self.ids[k], self.sizes[k] = np.r_[self.ids[k], ids], np.r_[self.sizes[k], sizes]
                whole &= given_back
            self.whole = np.r_[self.whole, whole]
            self.chars += sum(map(len, new))
        return places

    def tokens(self, k: int, places: np.ndarray) -> np.ndarray:
        """Side k's ids of units one after another."""
        sizes = self.sizes[k][places]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[k][places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[k][at].astype(np.int64)


class Aligner:
    """Two sides and what is looked up for each of their ids."""

    def __init__(self, a: ByteLevelSide | PieceSide, b: ByteLevelSide | PieceSide):
        self.sides = (a, b)
        self.by_unit = a.by_unit and b.by_unit
        self.units = Units(self.sides)
        # an id's text before another one of its group and side, and as the last one there
        self.names = tuple(np.array([f"{i}{end}" for i in range(len(s.pieces)) for end in (",", last)], object)
                           for s, last in zip(self.sides, "|;"))

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Places of the texts that both sides give back byte by byte, and each side's ids
        of them with their number by text."""
        if len(self.units.index) > KEPT_UNITS or self.units.chars > KEPT_CHARS:
            self.units = Units(self.sides)
        places = [i for i, t in enumerate(texts) if t]
        cut = [UNIT.split(texts[i]) if self.by_unit else [texts[i]] for i in places]
        of = self.units.numbers(list(chain.from_iterable(cut)))
        ends = np.cumsum([len(u) for u in cut], dtype=np.int64)
        keep, kept = [], []
        for i, a, b in zip(places, np.r_[0, ends].tolist(), ends.tolist()):
            here = of[a:b]
            if self.units.whole[here].all() or self.given_back(here, texts[i]):
                keep.append(i)
                kept.append(here)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(kept)), [len(u) for u in kept])
        sides = [(self.units.tokens(k, flat), np.bincount(doc, self.units.sizes[k][flat], len(kept)).astype(np.int64))
                 for k in range(2)]
        return np.array(keep, np.int64), sides

    def given_back(self, units: np.ndarray, text: str) -> bool:
        whole = b" " + text.encode("utf-8")
        return all(s.bytes_of(self.units.tokens(k, units)) == whole for k, s in enumerate(self.sides))

    def frames(self, kept: list[tuple[np.ndarray, np.ndarray]]) -> list[pd.DataFrame]:
        """Each side's tokens: doc, id, start, end.  Documents follow one another, so
        byte places rise over the whole frame."""
        out = []
        for (ids, counts), s in zip(kept, self.sides):
            size = s.lengths[ids]
            end = np.cumsum(size)
            doc = np.repeat(np.arange(len(counts)), counts)
            out.append(pd.DataFrame({"doc": doc, "id": ids, "start": end - size, "end": end}))
        return out

    @staticmethod
    def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all pairs of tokens whose byte ranges overlap.  Documents lie one
        after another, so a place is the document and the byte within it in one key: the
        token that covers a start is one of its own document."""
        rows = [pd.DataFrame({"start": s["start"], "row": np.arange(len(s))}) for s in (a, b)]
        of_a = pd.merge_asof(rows[0], rows[1], on="start")
        of_b = pd.merge_asof(rows[1], rows[0], on="start")
        once = b["start"].to_numpy() != a["start"].to_numpy()[of_b["row_y"]]   # else the first has the pair
        return (np.concatenate([of_a["row_x"].to_numpy(np.int64), of_b["row_y"].to_numpy(np.int64)[once]]),
                np.concatenate([of_a["row_y"].to_numpy(np.int64), of_b["row_x"].to_numpy(np.int64)[once]]))

    def groups(self, a: pd.DataFrame, b: pd.DataFrame, ending: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """Each document's groups as text (``a1,a2|b1;a3|b2``), given the rows of either side
        that end one."""
        is_last = [np.zeros(len(s), np.int64) for s in (a, b)]
        for last, rows in zip(is_last, ending):
            last[rows] = 1
        of = [np.cumsum(last) - last for last in is_last]           # group of each token
        size = [np.bincount(g) for g in of]
        before = [np.cumsum(n) - n for n in size]                   # tokens of the groups before
        tokens = np.empty(len(a) + len(b), object)
        tokens[np.arange(len(a)) + before[1][of[0]]] = self.names[0][2 * a["id"].to_numpy() + is_last[0]]
        tokens[np.arange(len(b)) + (before[0] + size[0])[of[1]]] = self.names[1][2 * b["id"].to_numpy() + is_last[1]]
        n_docs = int(a["doc"].iat[-1]) + 1
        cuts = np.cumsum(np.bincount(a["doc"], minlength=n_docs) + np.bincount(b["doc"], minlength=n_docs)).tolist()
        tokens = tokens.tolist()
        return ["".join(tokens[i:j])[:-1] for i, j in zip([0, *cuts], cuts)]


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def spread(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[places] = values
    return out


SCHEMA = ("u long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "links array<struct<pair: long, n: long>>")
SPANS = ", groups string, overlaps array<struct<a: long, b: long>>"


def align_batch(al: Aligner, u: pa.Array, doc_id: pa.Array, texts: list[str | None], with_spans: bool) -> pa.RecordBatch:
    n = len(texts)
    places, kept = al.encoded(texts)
    a, b = al.frames(kept)
    x, y = al.overlaps(a, b) if len(places) else (np.zeros(0, np.int64),) * 2
    doc = a["doc"].to_numpy()[x]
    ending = a["end"].to_numpy()[x] == b["end"].to_numpy()[y]
    group_texts = al.groups(a, b, (x[ending], y[ending])) if len(places) else []
    n_b = len(al.sides[1].pieces)
    n_pairs = len(al.sides[0].pieces) * n_b         # times the texts of a batch: far below 2^63
    key, size = np.unique(doc[ending] * n_pairs + a["id"].to_numpy()[x[ending]] * n_b + b["id"].to_numpy()[y[ending]],
                          return_counts=True)
    link_doc, pair = np.divmod(key, n_pairs)
    m = len(places)
    links = pa.StructArray.from_arrays([pa.array(pair // n_b * SHIFT + pair % n_b), pa.array(size.astype(np.int64))],
                                       names=["pair", "n"])
    sha = [""] * n
    for i, t in zip(places.tolist(), group_texts):
        sha[i] = hashlib.sha256(t.encode("ascii")).hexdigest()
    cols = [u, doc_id,
            pa.array(spread(places, kept[0][1], n)), pa.array(spread(places, kept[1][1], n)),
            *[pa.array(spread(places, np.bincount(doc[ending], minlength=m), n))] * 2,      # a group ends with its link
            pa.array(sha, pa.string()), list_array(spread(places, np.bincount(link_doc, minlength=m), n), links)]
    names = ["u", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    if with_spans:
        whole = [""] * n
        for i, t in zip(places.tolist(), group_texts):
            whole[i] = t
        starts = [np.r_[0, np.cumsum(np.bincount(s["doc"], minlength=m))][:-1] if m else np.zeros(0, np.int64) for s in (a, b)]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        doc = doc[order]
        spans = pa.StructArray.from_arrays([pa.array(x - starts[0][doc]), pa.array(y - starts[1][doc])], names=["a", "b"])
        cols += [pa.array(whole, pa.string()), list_array(spread(places, np.bincount(doc, minlength=m), n), spans)]
        names += ["groups", "overlaps"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          with_spans: bool = False) -> DataFrame:
    """Per row: u (a number of the row), doc_id, n_a and n_b (tokens), n_groups, n_links,
    groups_sha256 and links (distinct id pairs of the row and how often each is linked)
    and, ``with_spans``, groups (text) and overlaps (places of overlapping tokens).

    Null and empty texts, and those that a side does not give back byte by byte, have
    no tokens: zeros, an empty hash and no links.  Every row gives a row, repeated ones
    too; other columns are ignored; an empty table gives no row.  A text of any length
    is aligned whole, in memory that grows with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = Aligner(side(path_a), side(path_b))
        for batch in text_batches(batches, 2, TEXT_AT_ONCE):
            yield align_batch(al, batch.column(0), batch.column(1), batch.column(2).to_pylist(), with_spans)

    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (SPANS if with_spans else ""))


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, total, best``: how many links of the corpus each id pair has, and whether no
    other pair of its B id has more.  (A B id has at most one row for each A id.)"""
    totals = links.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair") % F.lit(SHIFT))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def with_counts(links: DataFrame, counts: DataFrame, n_pairs: int, n_links: int, most: int = BROADCAST_ROWS,
                hot_share: int = HOT_SHARE) -> DataFrame:
    """``links`` (u, pair, n) with total and best."""
    if n_pairs <= most:
        return links.join(F.broadcast(counts), "pair")
    hot = F.col("total") * hot_share > n_links           # fewer than hot_share pairs
    often = F.broadcast(counts.where(hot))
    return links.join(often, "pair").unionByName(
        links.join(often, "pair", "left_anti").join(counts.where(~hot), "pair"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
              broadcast_pairs: int = BROADCAST_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most
    frequent one of its B id in the corpus, ties included), count_sum (over links, how
    often their pair is linked in the corpus) and groups_sha256.  Rows as ``align`` has
    them."""
    aligned = written(align(docs, path_a, path_b, id_col, text_col), "aligned")
    links = aligned.select("u", F.inline("links"))
    counts = written(pair_counts(links), "pairs")
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("total").alias("links")).first()
    known = with_counts(links, counts, int(size["pairs"]), int(size["links"] or 0), broadcast_pairs, hot_share)
    sums = known.groupBy("u").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("links").join(sums, "u", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
