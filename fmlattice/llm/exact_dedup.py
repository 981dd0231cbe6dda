"""Exact duplicates by counting quotient filters.

Every partition of the documents builds counting quotient filters over the 64-bit
fingerprints of its normalised texts, one for each block (the fingerprint's first
bits, by which filters shuffle).  The next q bits are the quotient, the rest the
remainder, with q by the number of slots the entries need.  Remainders lie in a table
of slots of r + 1 bits, packed; a quotient's run is sorted and begins at its own slot
or where the run before it ends.  Two bits a slot say which quotients have a run and
where runs end, so nothing else of the quotient is stored.  Counts are encoded in
the run: a remainder once, twice, or followed by its count's digits, each behind a
mark.  Filters of a block merge without loss: their runs are scanned in order and equal remainders' counts
added.  A fingerprint whose merged count is one belongs to a text that occurs once;
the documents of all others go to a byte verification, which groups the whole
normalised texts.

Scale: what shuffles is one filter entry for each distinct fingerprint of a partition, the texts of fingerprints that occur more than once
(combined before the shuffle, so a text held by a third of all rows leaves each
task once), and light rows (id, fingerprint, SHA-256).  Blocks of quotients are
as many as the shuffle needs, so no task holds more than its share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, discard, groups, keep_decided, shuffle_partitions, written

# Up to so many repeated fingerprints (16 bytes each) are broadcast to the scan
# that routes texts to verification; beyond it, that join shuffles.
BROADCAST_FINGERPRINTS = 1_000_000
# Entries of the merged filter that one block is meant to hold.
BLOCK_ENTRIES = 1_000_000


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


LOAD = 0.95                 # of a filter's slots, at most
PACK_AT_ONCE = 1 << 16      # slots whose bits are spread out at a time


def pack_slots(values: np.ndarray, bits: int) -> bytes:
    """Values of ``bits`` bits one after another."""
    out, carry = [], np.zeros(0, np.uint8)
    places = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    for a in range(0, len(values), PACK_AT_ONCE):
        part = values[a:a + PACK_AT_ONCE, None] >> places & np.uint64(1)
        flat = np.concatenate([carry, part.astype(np.uint8).ravel()])
        whole = len(flat) // 8 * 8
        out.append(np.packbits(flat[:whole]).tobytes())
        carry = flat[whole:]
    return b"".join(out) + np.packbits(carry).tobytes()


def unpack_slots(data: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, n, PACK_AT_ONCE):         # a multiple of 8 slots begins a byte
        b = min(n, a + PACK_AT_ONCE)
        part = np.unpackbits(raw[a * bits // 8:-(-b * bits // 8)])[:(b - a) * bits].reshape(b - a, bits)
        for k in range(bits):
            out[a:b] = out[a:b] << np.uint64(1) | part[:, k]
    return out


def pack_filter(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of sorted distinct keys below ``2 ** width`` and their counts."""
    n_slots = int((np.minimum(counts, 3)).sum())
    q = min(width - 1, max(1, int(np.ceil(np.log2(max(1.0, n_slots / LOAD))))))
    r = width - q
    base = (1 << min(r + 1, 62)) - 1            # of a count's digits, stored with 1 added
    quotient = (keys >> np.uint64(r)).astype(np.int64)
    value = (keys & np.uint64((1 << r) - 1)) + np.uint64(1)         # 0 marks a digit
    size = np.minimum(counts, 2)
    left, digits = np.where(counts > 2, counts, 0), []
    while left.any():
        digits.append((left > 0, left % base))
        size = size + np.where(left > 0, 2, 0)
        left = left // base
    size = size - (counts > 2)                  # its remainder stands there once
    at = np.cumsum(size) - size
    slots = np.repeat(value, size)
    for k, (some, digit) in enumerate(digits):
        slots[at[some] + 1 + 2 * k] = 0
        slots[at[some] + 2 + 2 * k] = digit[some].astype(np.uint64) + np.uint64(1)
    first = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]])
    run = np.add.reduceat(size, first)
    before = np.cumsum(run) - run
    start = before + np.maximum.accumulate(quotient[first] - before)
    end = start + run - 1
    length = max(1 << q, int(end[-1]) + 1)
    occupied, ends = np.zeros(1 << q, bool), np.zeros(length, bool)
    occupied[quotient[first]], ends[end] = True, True
    table = np.zeros(length, np.uint64)
    table[np.arange(len(slots)) + np.repeat(start - before, run)] = slots
    head = np.array([q, length], "<i8").tobytes()
    return head + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + pack_slots(table, r + 1)


def scan_filter(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a packed filter, run after run."""
    q, length = np.frombuffer(data, "<i8", 2).tolist()
    r, at = width - q, 16
    n_bytes = [-(-(1 << q) // 8), -(-length // 8)]
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, n_bytes[0], at))[:1 << q])
    at += n_bytes[0]
    end = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, n_bytes[1], at))[:length])
    table = unpack_slots(data[at + n_bytes[1]:], r + 1, length)
    start = np.maximum(quotient, np.r_[0, end[:-1] + 1])
    run = end - start + 1
    before = np.cumsum(run) - run
    slots = table[np.arange(int(run.sum())) + np.repeat(start - before, run)]
    of = np.repeat(quotient, run)
    mark = np.flatnonzero(slots == 0)
    plain = np.ones(len(slots), bool)
    plain[mark] = plain[mark + 1] = False       # a mark and its digit
    twice = np.zeros(len(slots), bool)
    twice[1:] = plain[1:] & plain[:-1] & (slots[1:] == slots[:-1]) & (of[1:] == of[:-1])
    entry = np.flatnonzero(plain & ~twice)
    counts = np.ones(len(entry), np.int64)
    counts[np.searchsorted(entry, np.flatnonzero(twice) - 1)] = 2
    owner = np.searchsorted(entry, mark) - 1
    place = (mark - entry[owner] - 1) // 2      # of the digit in its count
    counts[owner] = 0
    base = (1 << min(r + 1, 62)) - 1
    for k in range(int(place.max()) + 1 if len(place) else 0):
        digit = place == k
        counts[owner[digit]] += (slots[mark[digit] + 1].astype(np.int64) - 1) * base ** k
    return of[entry].astype(np.uint64) << np.uint64(r) | (slots[entry] - np.uint64(1)), counts


class CountingQuotientFilter:
    """The filters of one partition, by block."""

    def __init__(self, block_bits: int):
        self.width = 64 - block_bits
        self.shift = np.uint64(64 - block_bits)
        self.mask = np.uint64((1 << (64 - block_bits)) - 1)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, fingerprints: np.ndarray) -> None:
        self.runs.append(np.unique(fingerprints.view(np.uint64), return_counts=True))
        if len(self.runs) > 16:
            self.runs = [merge_runs(self.runs)]

    def packed(self):
        """(block, filter) for every block that has entries."""
        if not self.runs:
            return
        keys, counts = merge_runs(self.runs)
        if not len(keys):
            return
        block = keys >> self.shift
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(keys)]):
            yield int(block[a]), pack_filter(keys[a:b] & self.mask, counts[a:b], self.width)

    def blocks(self):
        """(block, keys within it, counts), as the filters hold them."""
        for block, data in self.packed():
            yield block, *scan_filter(data, self.width)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs: equal keys become one with the sum of their counts."""
    keys = np.concatenate([r[0] for r in runs])
    counts = np.concatenate([r[1] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.add.reduceat(counts, cut)


def repeated_fingerprints(fingerprints: DataFrame, column: str, block_bits: int) -> DataFrame:
    """Fingerprints that occur more than once, by merged counting quotient filters:
    (fp long, n long)."""

    def build(batches):
        cqf = CountingQuotientFilter(block_bits)
        for b in batches:
            cqf.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
        rows = []
        for row in cqf.packed():
            rows.append(row)
            if len(rows) == 4096:
                yield filter_batch(rows)
                rows = []
        if rows:
            yield filter_batch(rows)

    def filter_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                          names=["block", "filter"])

    def merge(batches):
        shift = np.uint64(64 - block_bits)
        for g in groups(batches, ["block"]):
            keys, counts = merge_runs([scan_filter(f, 64 - block_bits) for f in g.column("filter").to_pylist()])
            keys, counts = keys[counts > 1], counts[counts > 1]
            block = np.uint64(g.column("block")[0].as_py())
            fps = (block << shift) | keys
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps.view(np.int64), pa.int64()), pa.array(counts, pa.int64())],
                names=["fp", "n"])

    parts = fingerprints.select(column).mapInArrow(build, "block long, filter binary")
    n = shuffle_partitions(fingerprints.sparkSession)
    return (parts.repartition(n, "block").sortWithinPartitions("block")
            .mapInArrow(merge, "fp long, n long"))


def block_bits_for(rows: int, partitions: int) -> int:
    """Blocks: one for each shuffle partition at least, and bounded entries in each."""
    blocks = max(partitions, rows // BLOCK_ENTRIES, 2)
    return min(32, max(1, int(blocks - 1).bit_length()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256,
    fp (the 64-bit fingerprint) and copies (rows with this id and this text).

    * Null text counts as empty, so all null and empty texts are one group; a text
      of white space only is another (one space).
    * ``keep_id`` is the smallest id of the group; null ids come last, so it is null
      only if all ids of the group are.
    * Repeated rows (same id, same text) are each returned; one of those with the
      smallest id has ``kept`` true.
    * Other columns are ignored, whatever their names.  An empty table gives no row.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    light = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"),
                F.monotonically_increasing_id().alias("uid")), "dedup-light")
    rows = light.count()
    bits = block_bits_for(rows, shuffle_partitions(spark))
    repeated = written(repeated_fingerprints(light, "fp", bits), "dedup-repeated", rows=rows)
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    routed_to = (F.broadcast(repeated) if few else repeated).select("fp")

    # byte verification: the texts themselves are the grouping key
    texts = (docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
             .join(routed_to, "fp", "left_semi")
             .groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("n_text"))
             .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n_text"))
    verified = texts.groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("n_texts"),
                                              F.sum("n_text").alias("n_rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    members = (light.join(routed_to, "fp", "left_semi").groupBy("fp", "sha")
               .agg(first.alias("first"), F.count(F.lit(1)).alias("size")))
    found = written(
        members.join(verified, ["fp", "sha"])
        .select("fp", "sha", F.col("first.doc_id").alias("keep"), F.col("first.uid").alias("keep_uid"),
                F.when((F.col("n_texts") == 1) & (F.col("n_rows") == F.col("size")), F.col("size"))
                .otherwise(F.raise_error(F.lit("different texts share fingerprint and SHA-256")).cast("long"))
                .alias("size")), "dedup-groups", rows=rows)
    discard(repeated)
    single = F.col("size").isNull()
    if found.count() <= BROADCAST_FINGERPRINTS // 4:
        found = F.broadcast(found)
    return light.join(found, ["fp", "sha"], "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with the columns of ``docs``."""
    return keep_decided(docs, F.xxhash64(normalised(F.col("text"))),
                        exact_dedup(docs).select("doc_id", "fp", "kept"))
