"""Best-fit packing into sequences of several permitted lengths.

A document of more tokens than the longest sequence is cut: full sequences, and a
rest.  Rests and shorter documents are pieces; they are dealt to shards of bounded
tokens by a hash, and each shard packs its pieces by length, longest first, into
the open bin that they leave the least room in.  A piece that fits no open bin
opens one.  Its size is decided by what is left to pack: for each permitted length the
piece and the largest remaining pieces that still fit are put together, and the length
whose bin, shrunk to that content, costs least for each token in it is opened.  At the
end every bin is shrunk to the shortest permitted length that holds its contents.

A shard also packs once for each length by itself (every bin opened at that length,
then shrunk) and keeps the cheapest of all, so the joint choice of lengths is never
dearer than best fit into any single one of them.

Only ids and counts shuffle (no text).  A shard is one sorted run of rows, so
shards add tasks, not size, as the input grows; the last bins of a shard are all
that sharding can waste.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RUN, groups, shuffle_partitions, written

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_TOKENS = 2_000_000
OVERHEAD_TOKENS = 32            # cost of a sequence besides its tokens
ATTENTION_LENGTH = 32_768       # length at which attention costs as much as all else


def sequence_cost(length: int) -> float:
    """Cost of one sequence: its tokens, attention (which grows with the square of
    the length) and a fixed share."""
    return length + length * length / ATTENTION_LENGTH + OVERHEAD_TOKENS


def pack(sizes: list[int], lengths=LENGTHS, cost=sequence_cost) -> tuple[list[int], list[int]]:
    """(bin of each piece, length of each bin), bins numbered in order of opening.
    ``sizes`` are in descending order, each at most the largest length."""
    lengths = sorted(lengths)
    best = None
    for opening in [joint_opening(sizes, lengths, cost), *(single_opening(sizes, lengths, c) for c in lengths)]:
        bins, room = best_fit_run(sizes, opening)
        # downsize every bin to its contents
        used = [0] * len(room)
        for b, s in zip(bins, sizes):
            used[b] += s
        final = [lengths[bisect_left(lengths, u)] for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, final)
    return best[1], best[2]


def single_opening(sizes, lengths, length):
    """Every bin is opened at ``length`` (a longer piece: at the shortest that holds it)."""
    return lambda i: next(c for c in lengths if c >= max(sizes[i], length))


def joint_opening(sizes, lengths, cost):
    """The length to open for piece i: of the bins that it and the largest pieces after it
    would make, the one that costs least for each token; the shorter one on ties."""
    n = len(sizes)
    falling = [-s for s in sizes]
    end = [n] * n                           # of the run of equal sizes
    for i in range(n - 2, -1, -1):
        end[i] = end[i + 1] if sizes[i] == sizes[i + 1] else i + 1

    def content(i: int, length: int) -> int:
        room, j = length - sizes[i], i + 1
        while room:
            j = max(j, bisect_left(falling, -room))
            if j >= n:
                break
            take = min(end[j] - j, room // sizes[j])
            room -= take * sizes[j]
            j += take
        return length - room

    def opened(i: int) -> int:
        def price(c: int) -> float:
            held = content(i, c)
            return cost(lengths[bisect_left(lengths, held)]) / held
        return min((c for c in lengths if c >= sizes[i]), key=lambda c: (price(c), c))

    return opened


def best_fit_run(sizes, opening):
    """Each piece into the open bin that it leaves the least room in, else into a new one."""
    rooms: list[tuple[int, int]] = []           # (room left, bin) of open bins, sorted
    bins, opened = [], []
    least = min(sizes, default=0)
    for i, s in enumerate(sizes):
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room = opening(i)
            b = len(opened)
            opened.append(room)
        bins.append(b)
        if room - s >= least:
            insort(rooms, (room - s, b))
    return bins, opened


def word_tokens(text: Column) -> Column:
    """Words of a text and one token that ends it; 0 for a text without a word."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RUN)).cast("long")
    return F.when(n > 0, n + 1).otherwise(F.lit(0).cast("long"))


def best_fit(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id",
             lengths=LENGTHS, shard_tokens: int = SHARD_TOKENS, cost=sequence_cost) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (token where it begins),
    n_tokens, bin_id, bin_length, bin_offset (place in its bin).

    ``tokens`` counts a row's tokens (default: words of ``text`` and an end mark); a
    null or negative count is 0.  A row of 0 tokens is one piece without a bin.
    Pieces cover each document without gap; none is dropped.  Rows with repeated or
    null ids are documents of their own.  Equal sizes are packed by id, then piece.
    Other columns are ignored; an empty table gives no row."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    count = word_tokens(F.col("text")) if tokens is None else tokens
    counted = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.greatest(F.coalesce(count.cast("long"), F.lit(0)), F.lit(0).cast("long")).alias("n"))
        .withColumn("uid", F.monotonically_increasing_id()), "pack-counted")
    total = counted.agg(F.sum(F.col("n") % longest)).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    parts = shuffle_partitions(docs.sparkSession)

    # full sequences of long documents need no packing
    full = (counted.where(F.col("n") >= longest)
            .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / longest) - 1)))
            .select("doc_id", "piece", (F.col("piece") * longest).alias("start"),
                    F.lit(longest).cast("long").alias("n_tokens"),
                    F.concat_ws("-", F.lit("f"), "uid", "piece").alias("bin_id"),
                    F.lit(longest).cast("long").alias("bin_length"), F.lit(0).cast("long").alias("bin_offset")))
    empty = counted.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n").alias("n_tokens"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_length"),
        F.lit(None).cast("long").alias("bin_offset"))
    rests = (counted.where(F.col("n") % longest > 0)
             .select("doc_id", "uid", F.floor(F.col("n") / longest).alias("piece"),
                     (F.col("n") - F.col("n") % longest).alias("start"), (F.col("n") % longest).alias("n_tokens"),
                     F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard")))

    def run(batches):
        for g in groups(batches, ["shard"]):
            sizes = g.column("n_tokens").to_numpy()
            shard = g.column("shard")[0].as_py()
            bins, final = pack(sizes.tolist(), lengths, cost)
            bins = np.array(bins)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            new = np.r_[True, bins[order][1:] != bins[order][:-1]]
            offset = np.zeros(len(bins), np.int64)
            offset[order] = before - np.repeat(before[new], np.diff(np.r_[np.flatnonzero(new), len(bins)]))
            out = [g.column("doc_id"), g.column("piece"), g.column("start"), g.column("n_tokens"),
                   pa.array([f"{shard}-{b}" for b in bins.tolist()], pa.string()),
                   pa.array(np.array(final)[bins], pa.int64()), pa.array(offset)]
            table = pa.table(out, names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_offset"])
            yield from table.to_batches()

    packed = (rests.repartition(parts, "shard")
              .sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "uid")
              .mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id string, "
                               "bin_length long, bin_offset long"))
    return packed.unionByName(full).unionByName(empty)
