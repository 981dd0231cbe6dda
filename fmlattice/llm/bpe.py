"""Byte-level BPE: encode with a segment tree over byte positions, and decode.

A piece (one match of the split pattern) starts as one token per byte.  The leaf
of a position holds the rank of the pair that starts there (the token there and
its next live neighbour), an inner node the least rank below it with the leftmost
position on ties; so the root is the pair to merge.  A merge joins two tokens,
takes the right one out of the list of live positions and updates three leaves:
the merged one, the one taken out and the live left neighbour.  A piece of n
bytes takes O(n log n) steps, whatever its content.

Texts are independent: a scan with an Arrow function, no shuffle.  Equal pieces
of a worker are encoded once while they fit a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

NO_PAIR = 1 << 60
CACHE_PIECES = 1 << 20      # entries of a worker's cache; it is emptied when full
CACHE_PIECE_CHARS = 64      # longer pieces are not kept


class PairTree:
    """Segment tree over positions.  A leaf is rank * width + position, so the least
    leaf has the least rank and, among equal ranks, the leftmost position."""

    def __init__(self, ranks: list[int]):
        n = 1
        while n < len(ranks):
            n *= 2
        self.width = n
        tree = [NO_PAIR] * n + [r * n + i for i, r in enumerate(ranks)] + [NO_PAIR] * (n - len(ranks))
        for i in range(n - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x < y else y
        self.tree = tree

    def update(self, position: int, rank: int) -> None:
        tree, n = self.tree, self.width
        i = n + position
        key = rank * n + position
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return      # nothing above changes
            tree[i] = key

    def first(self) -> tuple[int, int]:
        """(rank, position) of the pair to merge; the rank is NO_PAIR if there is none."""
        key = self.tree[1]
        return (key // self.width, key % self.width) if key < NO_PAIR else (NO_PAIR, 0)


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    token: list[bytes] = [piece[i:i + 1] for i in range(n)]
    after = list(range(1, n + 1))       # next live position; n ends the piece
    before = list(range(-1, n - 1))
    rank_of = ranks.get
    tree = PairTree([rank_of(piece[i:i + 2], NO_PAIR) for i in range(n - 1)] + [NO_PAIR])
    update, first = tree.update, tree.first
    while True:
        rank, i = first()
        if rank == NO_PAIR:
            break
        j = after[i]
        token[i] += token[j]
        k = after[i] = after[j]
        if tree.tree[tree.width + j] < NO_PAIR:
            update(j, NO_PAIR)
        if k < n:
            before[k] = i
            update(i, rank_of(token[i] + token[k], NO_PAIR))
        else:
            update(i, NO_PAIR)
        p = before[i]
        if p >= 0:
            update(p, rank_of(token[p] + token[i], NO_PAIR))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tokenizer:
    """Encode and decode whole texts by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {str(v): k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, str] = {}

    def ids(self, text: str) -> str:
        """Decimal ids joined by one space."""
        cache = self.cache
        pieces = self.split(text)
        try:
            return " ".join([cache[p] for p in pieces])
        except KeyError:
            return " ".join([cache.get(p) or self._encode(p) for p in pieces])

    def _encode(self, piece: str) -> str:
        out = " ".join(map(str, merge_piece(piece.encode("utf-8"), self.ranks)))
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def decode(self, ids: str) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in ids.split(" ")]) if ids else b""


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256 (of the decoded bytes) and, with ``with_ids``, ids array<int> and
    decoded (binary).

    Null and empty texts have no token: the digests are those of no bytes.  Every
    row gives a row, repeated ones too; other columns are ignored; an empty table
    gives no row.  A text of any length is encoded whole."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded binary"

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in text_batches(batches, 1):
            n, h_ids, h_bytes, all_ids, all_bytes = [], [], [], [], []
            for text in batch.column(1):
                ids = tok.ids(text.as_py() or "")
                decoded = tok.decode(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                h_ids.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                h_bytes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(" ")] if ids else [])
                    all_bytes.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(h_ids, pa.string()),
                    pa.array(h_bytes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
