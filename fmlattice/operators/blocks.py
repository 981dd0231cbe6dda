"""Conflict-free blocks of feature ids for exact block coordinate descent.

Updating features i < j one after the other differs from updating them at
once only through rows that hold both.  A contiguous id range in which no row
holds two ids can therefore be updated as one grouped aggregation and still
give exactly the sequential result (same ascending order).

* a one-hot or numeric field is such a block by construction;
* a list field (or libFM input, which has no field information) is cut
  greedily: the next block after start ``s`` begins at the smallest id ``b``
  that follows some id ``a >= s`` in a row.  Only adjacent ids in a row need
  checking.  A narrow field is cut on the driver from one collected aggregation.  A
  wide one is cut by *pointer doubling*: every possible start gets a pointer to the
  start after it (one suffix minimum, taken in two levels), and the starts that a
  chain of pointers from the first id meets are found by joining the pointer table
  with itself: as many rounds as the logarithm of the number of blocks;
* or, in another order than ascending ids, it is **coloured**: ids that meet in no
  row may share a colour, and a colour is a block.  A row is an edge of a hypergraph;
  in each round every uncoloured id proposes colours, each (row, colour) keeps the
  best of its proposers, and an id that all its rows keep for a colour takes it.  Memory
  is linear in the entries, whatever the length of a row.  A vocabulary whose
  neighbours all meet is as many blocks by the cut, and a small multiple of the
  longest list by colouring.  Colours are numbered first, ids within them, so that a
  colour is again a contiguous range (of relabelled ids); ``als.fit(order="coloured")``
  maps the parameters back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, fits_broadcast, literal_block_rows, maybe_broadcast
from .dictionary import dense_ids
from .vectorize import Block

RANGES = 1024           # ranges of ids whose minima are collected for the suffix minimum
SALT = 16               # parts of a key where a shuffle join may meet a hot one
GROW_BELOW = 0.25       # share of the open ids a round has to colour, or the palette grows
AIM = 0.5               # share of the ids that the second palette would have coloured in the first round
WORD = 62               # colours of a word: the bits of a number that is not negative
PIECE = 65_536          # entries about which the rows of a batch are contested at once
ROW = "open array<bigint>, word array<int>, wins array<bigint>, taken array<int>"      # of the table that is coloured


def adjacent_pairs(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """``near(b, a)``: for every id ``b`` in ``[lo, hi)`` the largest id ``a``
    in ``[lo, b)`` that directly precedes it in some row."""
    # the ids are a column before they are paired: a lambda that held the expression would
    # make the list anew for each pair
    held = rows.select(F.array_sort(F.array_distinct(F.transform(
        F.filter("features", lambda e: (e["feature_id"] >= lo) & (e["feature_id"] < hi)), lambda e: e["feature_id"]))).alias("ids"))
    before = F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0)))
    pairs = F.arrays_zip(before.alias("a"), F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0))).alias("b"))
    # outer: an inner generator is filtered by the size of its list, which would be made twice
    ex = held.select(pairs.alias("pairs")).select(F.explode_outer("pairs").alias("p")).where("p IS NOT NULL")
    return ex.groupBy(F.col("p.b").alias("b")).agg(F.max("p.a").alias("a"))


def greedy_cut(near: dict[int, int], lo: int, hi: int) -> list[tuple[int, int]]:
    """Ranges of ``[lo, hi)`` by ``near`` (b -> largest a before it in some row)."""
    out, s = [], lo
    for b in sorted(near):
        if near[b] >= s and b > s:
            out.append((s, b))
            s = b
    return out + [(s, hi)]


def salted_join(left: DataFrame, right: DataFrame, key: str, right_rows: int, how: str = "inner") -> DataFrame:
    """Join with a side of unique keys: broadcast under the checked size, else shuffled
    with every key in ``SALT`` parts, so that a key of many left rows is no single task."""
    if fits_broadcast(left.sparkSession, right_rows, 24 * right_rows):
        return left.join(F.broadcast(right), key, how)
    parts = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
    return left.withColumn("_salt", own).join(parts, [key, "_salt"], how).drop("_salt")


def next_starts(near: DataFrame, lo: int, hi: int) -> DataFrame:
    """``s, t`` for every possible start ``s`` (``lo`` and each ``b`` of ``near``): the least
    ``b`` that follows an ``a >= s`` in a row, or null.

    A suffix minimum over positions: within a range by a window, over the later ranges
    by their collected minima (at most ``RANGES``)."""
    spark = near.sparkSession
    width = max(1, -(-(hi - lo) // RANGES))
    slot = F.floor((F.col("pos") - F.lit(lo)) / F.lit(width)).cast("int")
    hops = near.groupBy(F.col("a").alias("pos")).agg(F.min("b").alias("t")).withColumn("slot", slot)
    least = {r["slot"]: r["t"] for r in hops.groupBy("slot").agg(F.min("t").alias("t")).collect()}
    later, best = [None] * (RANGES + 1), None
    for i in range(RANGES, -1, -1):
        later[i] = best
        best = min((x for x in (best, least.get(i)) if x is not None), default=None)
    starts = near.select(F.col("b").alias("pos")).unionByName(
        spark.range(1).select(F.lit(lo).cast("bigint").alias("pos"))).distinct()
    both = hops.unionByName(starts.withColumns({"t": F.lit(None).cast("bigint"), "slot": slot})).withColumn(
        "start", F.col("t").isNull())
    after = Window.partitionBy("slot").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.get(F.from_json(F.lit(json.dumps(later)), "array<bigint>"), F.col("slot"))
    return (both.withColumn("t", F.least(F.min("t").over(after), rest)).where("start")
            .select(F.col("pos").alias("s"), "t"))


def cut_points(rows: DataFrame, lo: int, hi: int, scratch: Scratch | None = None, rounds: list | None = None) -> DataFrame:
    """``s``: the starts of the greedy conflict-free ranges of ``[lo, hi)``, by pointer
    doubling.  ``rounds`` takes the number of starts known after each round."""
    scratch = scratch if scratch is not None else Scratch(rows.sparkSession, "cut")
    near = scratch.write(adjacent_pairs(rows, lo, hi), "near")
    jump = scratch.write(next_starts(near, lo, hi), "jump")
    reached = scratch.write(rows.sparkSession.range(1).select(F.lit(lo).cast("bigint").alias("s")), "reached")
    known = 1
    while True:
        before = [p for p in scratch.paths if "/reached-" in p or "/jump-" in p]
        # a chain goes on only from the starts that a pointer meets: the others leave the table,
        # which so shrinks from round to round
        met = jump.where("t IS NOT NULL").select(F.col("t").alias("s")).unionByName(reached).distinct()
        jump = scratch.write(jump.join(met.hint("merge"), "s", "left_semi"), "jump")
        n = jump.count()
        found = salted_join(reached, jump, "s", n).where("t IS NOT NULL").select(F.col("t").alias("s"))
        reached = scratch.write(reached.unionByName(found).distinct(), "reached")
        now = reached.count()
        if rounds is not None:
            rounds.append(now)
        if now == known:
            return reached
        known = now
        ahead = jump.select(F.col("s").alias("t"), F.col("t").alias("u"))
        restricted = scratch.paths[-2]
        jump = scratch.write(salted_join(jump.where("t IS NOT NULL"), ahead, "t", n).select("s", F.col("u").alias("t")), "jump")
        for path in [*before, restricted]:
            scratch.drop(path)


def cut_block(rows: DataFrame, block: Block) -> list[Block]:
    """Greedy conflict-free cut of one multi-valued block: on the driver if it is at most
    the literal bound wide (a number per id), else by pointer doubling."""
    if not block.multi or block.size <= 1:
        return [Block(block.name, block.offset, block.size, False)]
    if block.size <= literal_block_rows(rows.sparkSession):
        pairs = adjacent_pairs(rows, block.offset, block.end)
        near = {int(r["b"]): int(r["a"]) for r in pairs.collect()}
        cuts = greedy_cut(near, block.offset, block.end)
    else:
        scratch = Scratch(rows.sparkSession, "cut")
        starts = sorted(r["s"] for r in cut_points(rows, block.offset, block.end, scratch).collect())
        cuts = list(zip(starts, [*starts[1:], block.end]))
        scratch.drop_all()
    return [Block(f"{block.name}#{j}", s, t - s, False) for j, (s, t) in enumerate(cuts)]


def conflict_free_blocks(rows: DataFrame, blocks: list[Block]) -> list[Block]:
    """All blocks, multi-valued ones cut; ascending ids."""
    out: list[Block] = []
    for b in blocks:
        out.extend(cut_block(rows, b) if b.multi else [b])
    return [b for b in out if b.size > 0]


def libfm_blocks(rows: DataFrame, dimension: int) -> list[Block]:
    """Blocks for rows without field information (e.g. read from libFM)."""
    return conflict_free_blocks(rows, [Block("all", 0, dimension + 1, True)])


@dataclass
class Relabelling:
    """``old -> new`` ids of the coloured blocks, and the blocks of the new ids."""
    mapping: DataFrame | None       # old, new (written)
    size: int                       # rows of the mapping
    blocks: list[Block]


def contests(turn: int, palette: int, known=None):
    """A function of batches of rows (``open`` ids, the ``colour`` that each has just got or
    null, the colours ``taken`` in the row): rows of the ids that stay open, for each the set
    of colours of its ``word`` in which it is the row's best, and the colours taken.  Rows
    without an open id are left out.  ``known``: the new colours, as a broadcast pair of
    ascending ids and colours, instead of the column."""
    shift = np.uint64(turn * 0x9E3779B97F4A7C15 % 2 ** 64)
    factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * c + 1) + 2 * turn * 0xD1342543DE82EF95) % 2 ** 64 | 1) for c in range(WORD)]
    words = -(-palette // WORD)

    def mix(x: np.ndarray) -> np.ndarray:
        """A bijection: different ids stay different."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def flat(column, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
        """The values of a list column, nulls as -1, and their rows."""
        return (column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(kind),
                np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))

    def lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, row = flat(batch.column("open"))
        old, old_row = flat(batch.column("taken"))
        if known is None:
            colour, _ = flat(batch.column("colour"))
        else:
            at = np.searchsorted(known.value[0], ids)
            at[at == len(known.value[0])] = 0
            colour = np.where(known.value[0][at] == ids, known.value[1][at], -1).astype(np.int64)
        is_open = colour < 0
        taken = np.concatenate([old, colour[~is_open]])
        taken_row = np.concatenate([old_row, row[~is_open]])
        row, ids = row[is_open], ids[is_open]
        if not len(ids):
            return None
        kept, at = np.unique(row, return_inverse=True)      # rows by their new numbers
        place = np.searchsorted(kept, taken_row)
        there = (place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == taken_row)
        taken, taken_row = taken[there], place[there]
        # one contest for each row and word
        mixed = mix(ids.astype(np.uint64) + shift)
        word = (mixed % np.uint64(words)).astype(np.int64)
        key = at * words + word
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        group = np.cumsum(np.diff(key[order], prepend=-1) > 0) - 1
        keys = key[order][start]
        used = np.zeros(len(keys), np.uint64)
        its = taken_row * words + taken // WORD
        where = np.searchsorted(keys, its)
        meets = (where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == its)
        np.bitwise_or.at(used, where[meets], np.uint64(1) << (taken[meets] % WORD).astype(np.uint64))
        # times an odd number: no two ids of a contest are equal
        mixed = mix(mixed[order] + shift)
        best = np.zeros(len(ids), np.uint64)
        for c in range(min(WORD, palette)):
            strength = mixed * factors[c]
            best |= (strength == np.maximum.reduceat(strength, start)[group]).astype(np.uint64) << np.uint64(c)
        best &= ~used[group]
        ends = np.clip(palette - WORD * word[order], 0, WORD).astype(np.uint64)     # the last word is not whole
        best &= (np.uint64(1) << ends) - np.uint64(1)
        wins = np.empty(len(ids), np.int64)
        wins[order] = best.astype(np.int64)
        by_row = np.argsort(taken_row, kind="stable")
        return pa.RecordBatch.from_arrays(
            [lists(ids, at, len(kept), pa.int64()), lists(word.astype(np.int32), at, len(kept), pa.int32()),
             lists(wins, at, len(kept), pa.int64()), lists(taken[by_row].astype(np.int32), taken_row, len(kept), pa.int32())],
            ["open", "word", "wins", "taken"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("open").value_lengths().to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1), len(ends)]
            for a, b in zip(cuts, cuts[1:]):
                out = piece(batch.slice(a, b - a)) if b > a else None
                if out is not None:
                    yield out

    return run


def colours(rows: DataFrame, lo: int, hi: int, scratch: Scratch, rounds: list | None = None) -> DataFrame:
    """``id, colour`` for every id in ``[lo, hi)``: no row holds two ids of a colour.

    A round: each open id proposes the colours of a word of the palette (``WORD`` colours; a
    hash of id and round names the word); each row names for each colour, if no id of the row
    has it, the best of its proposers; an open id takes the first colour for which all its
    rows name it.  The palette begins with the longest row's length and grows when a round
    colours few; where the first does, its share says how often ids meet, and the palette
    grows at once to one that would have coloured ``AIM`` of them.  ``rounds`` takes the
    open ids before each round.

    A row is its open ids and its taken colours: a round's contests need no shuffle, and an
    id's colours are one number, combined before the shuffle by ids.  A round joins only the
    ids that the last one coloured, each of them once in all rounds; they and the rows
    without an open id then leave the table."""
    spark = rows.sparkSession
    ids = F.array_distinct(F.transform(F.filter("features", lambda e: (e["feature_id"] >= lo) & (e["feature_id"] < hi)),
                                       lambda e: e["feature_id"]))
    # the number keeps the filter from making the list a second time
    held = rows.select(ids.alias("open"), F.monotonically_increasing_id().alias("u")).where(F.size("open") > 1)
    table = scratch.write(held.select("open", F.array().cast("array<int>").alias("taken")), "entries")
    palette = table.agg(F.max(F.size("open"))).first()[0] or 1
    won, n_won, n_held, open_, turn, done = None, 0, 0, None, 0, None
    while open_ is None or open_:
        turn += 1
        before = [p for p in scratch.paths if "/entries-" in p]
        known = None
        if not n_won:
            given = table.select("open", F.transform("open", lambda _: F.lit(None).cast("int")).alias("colour"), "taken")
        elif fits_broadcast(spark, n_won, 24 * n_won):
            pairs = won.sort("id").toArrow()
            known = spark.sparkContext.broadcast((pairs["id"].to_numpy(), pairs["colour"].to_numpy()))
            given = table.select("open", "taken")
        else:       # shuffled: the rows are put together again
            ex = table.withColumn("u", F.monotonically_increasing_id()).select("u", "taken", F.posexplode("open").alias("pos", "id"))
            ex = salted_join(ex.withColumn("taken", F.when(F.col("pos") == 0, F.col("taken"))), won, "id", n_won, "left")
            given = ex.groupBy("u").agg(F.collect_list(F.struct("id", "colour")).alias("ids"), F.first("taken", True).alias("taken")).select(
                F.col("ids.id").alias("open"), F.col("ids.colour").alias("colour"), "taken")
        table = scratch.write(given.mapInArrow(contests(turn, palette, known), ROW), "entries")
        if known is not None:
            known.destroy()
        wins = table.select(F.inline(F.arrays_zip("open", "word", "wins")).alias("id", "word", "wins"))
        seen = scratch.write(wins.groupBy("id").agg(F.bit_and("wins").alias("wins"), F.first("word").alias("word")), "won")
        if done is None:
            # an id that meets no other one needs no round
            done = spark.range(lo, hi).join(seen.select("id").hint("merge"), "id", "left_anti").select("id", F.lit(0).alias("colour"))
            open_ = n_held = seen.count()
            if not open_:
                break
        if rounds is not None:
            rounds.append(open_)
        lowest = F.bit_count(F.col("wins").bitwiseAND(-F.col("wins")) - 1)
        won = seen.where("wins <> 0").select("id", (F.col("word") * WORD + lowest).cast("int").alias("colour"))
        n_won = won.count()
        done = done.unionByName(won)
        for path in before:
            scratch.drop(path)
        share = n_won / open_
        if share < GROW_BELOW:
            jump = int(palette * AIM / share) if turn == 1 and n_won else 0
            palette = max(palette + max(1, palette // 4), min(jump, n_held))
        open_ -= n_won
    return scratch.write(done, "colour").select("id", "colour")


def coloured_blocks(rows: DataFrame, blocks: list[Block], scratch: Scratch) -> Relabelling:
    """Blocks with the multi-valued ones coloured; ids outside those keep their number."""
    out, maps, size = [], [], 0
    for b in blocks:
        if not b.multi or b.size <= 1:
            out.append(Block(b.name, b.offset, b.size, False))
            continue
        mark = scratch.mark()
        state = colours(rows, b.offset, b.end, scratch)
        token = F.format_string("%010d:%019d", F.col("colour"), F.col("id"))
        coded, n = dense_ids(state.select(token.alias("token")), b.size)
        mapping = scratch.write(coded.select(
            F.substring("token", 12, 19).cast("bigint").alias("old"),
            (F.col("code") + F.lit(b.offset)).alias("new")), "relabel")
        per = sorted((r["colour"], r["count"]) for r in state.groupBy("colour").count().collect())     # colours are few
        at = b.offset
        for c, width in per:
            out.append(Block(f"{b.name}~{c}", at, width, False))
            at += width
        for path in scratch.paths[mark:]:
            if "/relabel-" not in path:
                scratch.drop(path)
        maps.append(mapping)
        size += n
    mapping = None
    for m in maps:
        mapping = m if mapping is None else mapping.unionByName(m)
    return Relabelling(mapping, size, [b for b in out if b.size > 0])


def relabelled(rows: DataFrame, r: Relabelling) -> DataFrame:
    """``row_id, y, features`` with the new ids, ascending; each row is shuffled once."""
    if r.mapping is None:
        return rows
    ent = rows.select("row_id", "y", "features").withColumn("_u", F.monotonically_increasing_id()) \
              .select("_u", "row_id", "y", F.inline_outer("features"))
    m = maybe_broadcast(r.mapping, r.size, extra_bytes=16 * r.size)
    j = ent.join(m, F.col("feature_id") == F.col("old"), "left")
    e = F.when(F.col("feature_id").isNotNull(), F.struct(F.coalesce("new", "feature_id").alias("feature_id"), "value"))
    return j.groupBy("_u").agg(F.first("row_id").alias("row_id"), F.first("y").alias("y"),
                               F.array_sort(F.collect_list(e)).alias("features")).drop("_u")


def renumbered(params: DataFrame, r: Relabelling, back: bool = False) -> DataFrame:
    """The parameter table by new ids or, ``back``, by old ones."""
    if r.mapping is None:
        return params
    frm, to = ("new", "old") if back else ("old", "new")
    m = maybe_broadcast(r.mapping.select(F.col(frm).alias("_from"), F.col(to).alias("_to")), r.size, extra_bytes=16 * r.size)
    j = params.join(m, F.col("feature_id") == F.col("_from"), "left")
    return j.select(F.coalesce("_to", "feature_id").alias("feature_id"), *[c for c in params.columns if c != "feature_id"])
