"""Exact coordinate descent ("ALS") for second-order FMs, as Spark jobs.

An iteration is

1. **residuals**: a scoring pass rebuilds ``e = ŷ − y`` and ``q_f = Σ v_f x`` of
   every row from the parameters (stops drift; also the RMSE of the trace);
2. **global bias**: ``w0' = −(Σe − w0·n)/(reg0 + n)``, ``e += w0' − w0``;
3. **linear sweep**: for every conflict-free block (ascending ids)
   ``θ' = −(Σeh − θΣh²)/(reg + Σh²)`` with ``h = x``, then ``e += h·Δ``;
4. **factor sweeps**: per factor f, the same with ``h = x·q_f − x²·v_f`` and
   also ``q_f += x·Δ``.

A block holds at most one id per row, so updating it at once equals updating
its ids one by one.

Tables.  The training rows are written once, bucketed by row id, and so are, once per
fit, the entries of every ``fmlattice.segmentBlocks`` blocks, as plain columns
(``l{j}``: id − block start, ``x{j}``: value).  The state that changes is only ``row_id,
e`` (and ``q`` within a factor's sweep).  All joins of these are bucket by bucket.

Steps.  A *segment* is a run of narrow blocks (at most ``fmlattice.literalBlockRows``
wide) that ``gram`` solves with one aggregation job: a few sums for each of at most
``fmlattice.gramCells`` cells reach the driver, and the rows are changed by a projection
with array literals.  That projection is not a job: it is part of the next one that
reads the rows, and the state is written only after ``PENDING`` of them, or where a
segment's columns are in another table and several changes wait.  So a pass has about
one job for each segment and parameter family.  Where all segments share one table (few
blocks), the state holds its columns throughout, no step joins or places rows by their
ids, and a wide block's changes may wait, too, as a broadcast join.

A wider block is a segment by itself.  Its statistics need no old value per row: with
``h = xq − x²t``, ``Σh² = S(x²q²) − 2t S(x³q) + t² S(x⁴)`` and ``Σeh = S(exq) − t S(ex²)``, so
five sums per feature are combined on the map side and only then joined to one row per
feature; a feature held by a third of all rows is no single task.  Its table of changes
is written and joined back, broadcast if its exact size is under the checked bound, else
by a shuffle of the rows that have an entry; then, as a rule, the state is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, fits_broadcast, gram_cells, literal_block_rows, maybe_broadcast, segment_blocks
from . import gram
from .blocks import coloured_blocks, relabelled, renumbered
from .gram import ROUNDING, array_literal, number_literal
from .model import FMConfig, FMModel, init_params, interaction_expr, score_sums
from .vectorize import Block

# Changed values of narrow blocks kept on the driver before they are written, and old
# values read at once.
KEPT_UPDATES = 100_000
KEPT_VALUES = 1_000_000
# Changes of the rows that wait, as projections, before the state is written.
PENDING = 8


# ---- helpers ---------------------------------------------------------------

def block_entry(lo: int, hi: int) -> Column:
    """The row's (at most one) entry whose id lies in ``[lo, hi)``, or null."""
    return F.get(F.filter("features", lambda e: (e["feature_id"] >= lo) & (e["feature_id"] < hi)), 0)


def entry_columns(block: Block, j: int) -> list[Column]:
    """``l{j}``, ``x{j}`` of a block: id − block start, and value (null if none)."""
    e = block_entry(block.offset, block.end)
    return [(e["feature_id"] - F.lit(block.offset)).cast("int").alias(f"l{j}"), e["value"].alias(f"x{j}")]


def block_columns(blocks: list[Block]) -> list[Column]:
    return [c for j, b in enumerate(blocks) for c in entry_columns(b, j)]


def strength_column(slot: str) -> str:
    """The parameter table's column of a family's own strengths by feature, if it has one."""
    return "_regw" if slot == "w" else "_regv"


def with_strengths(params: DataFrame, groups: DataFrame, strengths: dict[int, tuple[float, float]], cfg: FMConfig,
                   dimension: int) -> DataFrame:
    """``params`` with each feature's regularisation (of w and of v) by its attribute group
    (``feature_id, group_id``); groups and features without one have the model's."""
    rows = [(int(g), float(w), float(v)) for g, (w, v) in strengths.items()]
    table = F.broadcast(params.sparkSession.createDataFrame(rows, "group_id bigint, _regw double, _regv double"))
    own = groups.select("feature_id", "group_id").join(table, "group_id").select("feature_id", "_regw", "_regv")
    j = params.join(maybe_broadcast(own, dimension, extra_bytes=24 * dimension), "feature_id", "left")
    return j.select(*params.columns, F.coalesce("_regw", F.lit(float(cfg.regw))).alias("_regw"),
                    F.coalesce("_regv", F.lit(float(cfg.regv))).alias("_regv"))


def theta_columns(params: DataFrame, slot: str) -> list[Column]:
    """``feature_id``, the old value and, where features have strengths of their own, ``reg``."""
    own = [F.col(strength_column(slot)).alias("reg")] if strength_column(slot) in params.columns else []
    return [F.col("feature_id"), F.col(slot).alias("theta"), *own]


def updated_theta(theta: Column, sum_hh: Column, sum_eh: Column, reg: float | Column) -> Column:
    """``−(Σeh − θΣh²)/(reg + Σh²)``; the old value is kept when the new one
    is not finite (or the denominator is 0)."""
    reg = reg if isinstance(reg, Column) else F.lit(float(reg))
    new = F.try_divide(-(sum_eh - theta * sum_hh), reg + sum_hh)
    finite = new.isNotNull() & ~F.isnan(new) & (F.abs(new) != F.lit(float("inf")))
    return F.when(finite, new).otherwise(theta)


def spread_null(key: Column, row_id: Column) -> Column:
    """``key`` (not negative), or a negative number of the row's own: null keys of a
    shuffle join do not meet in one task, and match nothing."""
    return F.coalesce(key.cast("bigint"), F.lit(-1).cast("bigint") - F.pmod(F.xxhash64(row_id), F.lit(1 << 40)))


def placed_join(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Join of two tables placed by ``key``: bucket by bucket, so the result is placed
    too (a broadcast of the smaller one would read them without their buckets)."""
    return left.join(right.hint("merge"), key)


# ---- training rows ----------------------------------------------------------

@dataclass
class Segment:
    """Consecutive blocks that are solved together, or one wide block.  ``table`` holds the
    entries, ``row_id, l0, x0, l1, x1, ...``: block j in the columns ``at[j]``, its constant
    value (None: it varies) in ``constants[j]``.  Segments may share a table."""
    blocks: list[Block]
    table: DataFrame
    constants: list[float | None]
    at: list[int]

    def wide(self, spark) -> bool:
        return self.blocks[0].size > literal_block_rows(spark)


@dataclass
class Training:
    """Training rows placed by ``row_id`` and the segments of their blocks."""
    rows: DataFrame
    segments: list[Segment]
    parts: int
    scratch: Scratch
    paths: list[str] = field(default_factory=list)     # what lives as long as the training


def cut_segments(blocks: list[Block], size: int) -> list[list[Block]]:
    return [blocks[i:i + size] for i in range(0, len(blocks), size)]


def place_rows(rows: DataFrame, scratch: Scratch, columns: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Write ``row_id, y, features`` (and ``columns``) bucketed by row id.  Ids that are
    null or repeat are replaced by new ones, drawn from rows written as they come: by the
    old ids, rows of one id would meet in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = scratch.write(rows.select("row_id", "y", "features", *columns), "given")
    path = scratch.last()
    if (not kept.where("row_id IS NULL").isEmpty()
            or not kept.groupBy("row_id").count().where("count > 1").isEmpty()):
        kept = kept.withColumn("row_id", F.monotonically_increasing_id())
    placed = scratch.place(kept, "row_id", parts, "rows")
    scratch.drop(path)
    return placed, parts


def joined_by_id(frame: DataFrame, j: int, table: DataFrame, key: str, rows: int, extra_bytes: int) -> DataFrame:
    """Left join of block ``j``'s ids with a table of ``rows`` rows by ``key``: a broadcast
    if it fits, else a shuffle of the rows that have an entry only."""
    at = F.col(f"l{j}")
    on = at.cast("bigint") == F.col(key)
    if fits_broadcast(frame.sparkSession, rows, extra_bytes):
        return frame.join(F.broadcast(table), on, "left")
    blank = [F.lit(None).cast(t).alias(c) for c, t in table.dtypes]
    return (frame.where(at.isNotNull()).join(table, on, "left")
            .unionByName(frame.where(at.isNull()).select("*", *blank)))


def one_table(segments: list[Segment]) -> DataFrame | None:
    """The table that all segments share, if there is one."""
    return segments[0].table if len({id(s.table) for s in segments}) == 1 else None


def place_segments(placed: DataFrame, blocks: list[Block], parts: int, scratch: Scratch) -> list[Segment]:
    """Write the entries of the blocks and cut these into segments; blocks that no row
    touches have no update and are left out."""
    out, spark = [], placed.sparkSession
    for part in cut_segments(blocks, segment_blocks(spark)):
        table = scratch.place(placed.select("row_id", *block_columns(part)), "row_id", parts, "segment", placed=True)
        path = scratch.last()
        segments = measured_segments(table, part)
        if not segments:
            scratch.drop(path)
        out += segments
    return out


def measured_segments(table: DataFrame, blocks: list[Block]) -> list[Segment]:
    """Segments of one table's blocks, by which of them occur and have a constant value."""
    spark = table.sparkSession
    hit = table.agg(*[f(f"x{j}").alias(f"{n}{j}") for j in range(len(blocks))
                      for f, n in ((F.count, "n"), (F.min, "a"), (F.max, "b"))]).first()
    live = [j for j in range(len(blocks)) if hit[f"n{j}"]]
    some = [blocks[j] for j in live]
    constants = [hit[f"a{j}"] if hit[f"a{j}"] == hit[f"b{j}"] else None for j in live]
    return [Segment([some[i] for i in run], table, [constants[i] for i in run], [live[i] for i in run])
            for run in gram.runs(some, constants, literal_block_rows(spark), gram_cells(spark))]


def prepare(rows: DataFrame, blocks: list[Block], scratch: Scratch | None = None) -> Training:
    """Write what every pass reads: the rows, and their entries by segment."""
    scratch = scratch if scratch is not None else Scratch(rows.sparkSession, "als")
    mark = scratch.mark()
    placed, parts = place_rows(rows, scratch)
    segments = place_segments(placed, blocks, parts, scratch)
    return Training(placed, segments, parts, scratch, scratch.paths[mark:])


# ---- residuals and bias -----------------------------------------------------

def residuals(rows: DataFrame, params: DataFrame, w0: float, cfg: FMConfig,
              dimension: int | None = None) -> DataFrame:
    """``row_id, e, q*``: ``e = ŷ − y`` and ``q_f = Σ v_f x`` (unique row ids)."""
    sums = score_sums(rows, params, cfg, dimension)
    j = rows.select("row_id", "y").join(sums.hint("merge"), "row_id", "left")
    lin = F.coalesce(F.col("lin"), F.lit(0.0)) if cfg.k1 else F.lit(0.0)
    pred = (number_literal(float(w0)) if cfg.k0 else F.lit(0.0)) + lin + F.coalesce(interaction_expr(cfg.k), F.lit(0.0))
    return j.select("row_id", (pred - F.col("y")).alias("e"),
                    *[F.coalesce(F.col(f"s{f}"), F.lit(0.0)).alias(f"q{f}") for f in range(cfg.k)])


def factor_sums(rows: DataFrame, params: DataFrame, cfg: FMConfig, dimension: int | None = None
                ) -> DataFrame:
    """``row_id, q0 .. q{k-1}`` with ``q_f = Σ v_f x`` (unique row ids)."""
    sums = score_sums(rows, params, cfg, dimension)
    return rows.select("row_id").join(sums, "row_id", "left").select(
        "row_id", *[F.coalesce(F.col(f"s{f}"), F.lit(0.0)).alias(f"q{f}") for f in range(cfg.k)])


def state_summary(state: DataFrame) -> tuple[float, int, float]:
    """One scalar job over the residual state: ``Σe``, ``n``, RMSE."""
    r = state.agg(F.sum("e").alias("se"), F.count(F.lit(1)).alias("n"),
                  F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")).first()
    return float(r["se"] or 0.0), int(r["n"]), float(r["rmse"] or 0.0)


def global_bias_update(w0: float, se: float, n: int, reg0: float) -> float:
    denom = reg0 + n
    new = -(se - w0 * n) / denom if denom != 0 else float("nan")
    if new != new or new in (float("inf"), float("-inf")):
        return w0
    return new


def global_bias_step(state: DataFrame, w0: float, cfg: FMConfig,
                     summary: tuple[float, int, float] | None = None) -> tuple[DataFrame, float]:
    """``w0' = −(Σe − w0·n)/(reg0 + n)`` and ``e += w0' − w0``."""
    se, n, _ = summary or state_summary(state)
    new = global_bias_update(w0, se, n, cfg.reg0)
    return state.withColumn("e", F.col("e") + number_literal(new - w0)), new


@dataclass
class PassState:
    """Start of a pass: the errors after the bias step and each factor's sums."""
    errors: DataFrame           # row_id, e
    sums: DataFrame             # row_id, q0 .. q{k-1}
    w0: float
    rmse: float
    state: DataFrame            # row_id, e, q0 .. q{k-1}


def start_pass(train: Training, params: DataFrame, w0: float, cfg: FMConfig, dimension: int,
               table: DataFrame | None = None) -> PassState:
    """``table``: a segment table whose columns the state shall hold."""
    first = residuals(train.rows, params, w0, cfg, dimension)
    if table is None:
        state = train.scratch.place(first, "row_id", train.parts, "state", placed=True)
    else:
        state = train.scratch.write(placed_join(table, first), "state")
    return started(state, w0, cfg)


def started(state: DataFrame, w0: float, cfg: FMConfig) -> PassState:
    """The pass's start on its written residuals."""
    summary = state_summary(state)
    if cfg.k0:
        state, w0 = global_bias_step(state, w0, cfg, summary)
    return PassState(state.select("row_id", "e"), state.select("row_id", *sum_columns(state)), w0, summary[2], state)


def sum_columns(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c[0] == "q"]


def column_residuals(table: DataFrame, segments: list[Segment], params: DataFrame, values: Values, w0: float,
                     cfg: FMConfig) -> DataFrame:
    """``table`` (``row_id, y`` and the columns of all blocks) with ``e`` in place of ``y``, and
    ``q*``: each block's old values are looked up by its own column, so that no row's
    entries are listed and grouped again.  Each id is in one block."""
    slots = [slot for slot, _ in families(cfg)]
    frame, terms = table, {slot: [] for slot in slots}
    for n, (seg, i) in enumerate((seg, i) for seg in segments for i in range(len(seg.blocks))):
        block, j = seg.blocks[i], seg.at[i]
        if seg.wide(table.sparkSession):
            old = params.where((F.col("feature_id") >= block.offset) & (F.col("feature_id") < block.end)).select(
                (F.col("feature_id") - F.lit(block.offset)).alias("_id"), *[F.col(s).alias(f"_p{s}") for s in slots])
            frame = joined_by_id(frame, j, old, "_id", block.size, 8 * (len(slots) + 1) * block.size)
            found = {s: F.coalesce(F.col(f"x{j}") * F.col(f"_p{s}"), F.lit(0.0)) for s in slots}
        else:
            run = gram.Run(seg.blocks, seg.constants, values.of(seg, slots[0]), seg.at)
            found = {s: gram.times(run, values.of(seg, s)[i], i) for s in slots}
        frame = frame.select(*[c for c in frame.columns if c != "_id" and not c.startswith("_p")],
                             *[c.alias(f"_t{n}_{s}") for s, c in found.items()])
        for s in slots:
            terms[s].append(F.col(f"_t{n}_{s}"))

    def total(columns: list[Column]) -> Column:
        out = F.lit(0.0)
        for c in columns:
            out = out + c
        return out

    frame = frame.withColumns({f"q{f}": total(terms[f"v{f}"]) for f in range(cfg.k)})
    pred = (number_literal(float(w0)) if cfg.k0 else F.lit(0.0)) + total(terms.get("w", []))
    for f in range(cfg.k):
        q = F.col(f"q{f}")
        pred = pred + F.lit(0.5) * (q * q - total([t * t for t in terms[f"v{f}"]]))
    return frame.select(*[c for c in table.columns if c != "y"], (pred - F.col("y")).alias("e"),
                        *[f"q{f}" for f in range(cfg.k)])


# ---- one block -------------------------------------------------------------
# A work frame holds row_id, e, (q in a factor's sweep) and the segment's columns.

def work_frame(segment: Segment, errors: DataFrame, sums: DataFrame | None = None, factor: int | None = None) -> DataFrame:
    work = placed_join(segment.table, errors)
    if factor is not None:
        work = placed_join(work, sums.select("row_id", F.col(f"q{factor}").alias("q")))
    return work


def block_sums(work: DataFrame, j: int, block: Block, factor: bool) -> DataFrame:
    """``feature_id`` and its sums, combined on the map side; no old value per row is needed."""
    e, x, q = F.col("e"), F.col(f"x{j}"), F.col("q")
    sums = ({"s_xx": x * x, "s_ex": e * x} if not factor else
            {"s_hh": x * x * q * q, "s_xq": x * x * x * q, "s_x4": x * x * x * x, "s_eq": e * x * q, "s_exx": e * x * x})
    feature = F.col(f"l{j}") + F.lit(block.offset).cast("bigint")
    return (work.where(F.col(f"l{j}").isNotNull()).groupBy(feature.alias("feature_id"))
            .agg(*[F.sum(c).alias(n) for n, c in sums.items()]))


def theta_stats(work: DataFrame, params: DataFrame, j: int, block: Block, slot: str) -> DataFrame:
    """``feature_id, theta, sum_hh, sum_eh`` for the ids of block ``j`` of a work frame.
    ``slot`` is ``w`` or ``v{f}``."""
    factor = slot != "w"
    spark = work.sparkSession
    sums = block_sums(work, j, block, factor)
    theta = params.where((F.col("feature_id") >= block.offset) & (F.col("feature_id") < block.end)) \
                  .select(*theta_columns(params, slot))
    return stats_of_sums(sums.join(maybe_broadcast(theta, block.size, spark, 16 * block.size), "feature_id", "left"), factor)


def stats_of_sums(sums: DataFrame, factor: bool) -> DataFrame:
    """``feature_id, theta, sum_hh, sum_eh`` of summed products joined with the old values."""
    t = F.coalesce(F.col("theta"), F.lit(0.0))
    if not factor:
        hh, eh = F.col("s_xx"), F.col("s_ex")
    else:
        whole = F.col("s_hh") + t * t * F.col("s_x4")
        hh = F.col("s_hh") - F.lit(2.0) * t * F.col("s_xq") + t * t * F.col("s_x4")
        none = hh <= F.lit(ROUNDING) * whole
        eh = F.when(none, F.lit(0.0)).otherwise(F.col("s_eq") - t * F.col("s_exx"))
        hh = F.when(none, F.lit(0.0)).otherwise(hh)
    return sums.select("feature_id", t.alias("theta"), hh.alias("sum_hh"), eh.alias("sum_eh"),
                       *[c for c in sums.columns if c == "reg"])


def theta_update(stats: DataFrame, reg: float) -> DataFrame:
    """``feature_id, theta, new, delta`` for the ids whose value changes.  ``stats`` with a
    column ``reg`` bring their own strengths."""
    own = F.coalesce(F.col("reg"), F.lit(float(reg))) if "reg" in stats.columns else reg
    new = updated_theta(F.col("theta"), F.col("sum_hh"), F.col("sum_eh"), own)
    return (stats.select("feature_id", "theta", new.alias("new"))
            .withColumn("delta", F.col("new") - F.col("theta"))
            .where(F.col("delta") != 0))


def _applied(work: DataFrame, j: int, factor: bool, theta: Column, delta: Column) -> list:
    """The work frame's columns after ``e += h·Δ`` (and ``q += x·Δ``)."""
    x = F.coalesce(F.col(f"x{j}"), F.lit(0.0))
    if not factor:
        h = x
    else:
        h = x * F.col("q") - x * x * theta
    new = {"e": F.col("e") + h * delta} | ({"q": F.col("q") + x * delta} if factor else {})
    return [new[c].alias(c) if c in new else c for c in work.columns]


def delta_rows(delta: DataFrame, block: Block) -> int:
    """A bound of a written table's changes that says whether it can be broadcast: the
    block's width if that will do, else the exact count."""
    return block.size if fits_broadcast(delta.sparkSession, block.size, 24 * block.size) else delta.count()


def error_update(work: DataFrame, delta: DataFrame, j: int, block: Block, factor: bool,
                 rows: int | None = None) -> DataFrame:
    """``e += h·Δ`` (and ``q += x·Δ``) on the rows holding an updated id of a wide
    block, by a join with its table of changes (of ``rows`` rows; else as wide as the block)."""
    d = delta.select((F.col("feature_id") - F.lit(block.offset)).alias("_dl"), F.col("theta").alias("_dth"),
                     F.col("delta").alias("_dd"))
    rows = block.size if rows is None else rows
    joined = joined_by_id(work, j, d, "_dl", rows, 24 * rows)
    return joined.select(*_applied(work, j, factor, F.coalesce(F.col("_dth"), F.lit(0.0)),
                                   F.coalesce(F.col("_dd"), F.lit(0.0))))


# ---- sweeps ----------------------------------------------------------------

class Updates:
    """New values of a pass: a bounded number of rows here, the rest in written tables."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.rows, self.tables = scratch, [], []

    SCHEMA = "feature_id bigint, slot string, new double"

    def add_run(self, slot: str, run: gram.Run, new: list[list[float]]) -> None:
        for block, olds, news in zip(run.blocks, run.thetas, new):
            self.rows += [(block.offset + i, slot, v) for i, (u, v) in enumerate(zip(olds, news)) if u != v]
        if len(self.rows) >= KEPT_UPDATES:
            self.tables.append(self.scratch.write(self.scratch.spark.createDataFrame(self.rows, self.SCHEMA), "new"))
            self.rows = []

    def add_table(self, slot: str, delta: DataFrame) -> None:
        self.tables.append(delta.select("feature_id", F.lit(slot).alias("slot"), "new"))

    def frame(self) -> DataFrame | None:
        parts = list(self.tables)
        if self.rows:
            parts.append(self.scratch.spark.createDataFrame(self.rows, self.SCHEMA))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def apply(self, params: DataFrame, dimension: int) -> DataFrame:
        """``params`` with the new values, by one join."""
        new = self.frame()
        if new is None:
            return params
        slots = [c for c in params.columns if c != "feature_id"]
        wide = new.groupBy("feature_id").agg(*[
            F.max(F.when(F.col("slot") == s, F.col("new"))).alias(f"_{s}") for s in slots])
        j = params.join(maybe_broadcast(wide, dimension, extra_bytes=8 * len(slots) * dimension), "feature_id", "left")
        return j.select("feature_id", *[F.coalesce(F.col(f"_{s}"), F.col(s)).alias(s) for s in slots])


class Values:
    """Old values of the narrow blocks' ids, for all families of a pass: read at once while
    they are few, else segment by segment."""

    def __init__(self, params: DataFrame, segments: list[Segment], slots: list[str]):
        own = sorted({strength_column(s) for s in slots} & set(params.columns))
        self.params, self.slots = params, [*slots, *own]
        self.spark = params.sparkSession
        narrow = [b for s in segments if not s.wide(self.spark) for b in s.blocks]
        self.all = self._read(narrow) if sum(b.size for b in narrow) * len(self.slots) <= KEPT_VALUES else None

    def _read(self, blocks: list[Block]) -> dict[tuple[str, int], list[float]]:
        cond = F.lit(False)
        for lo, hi in joined_ranges(blocks):
            cond = cond | ((F.col("feature_id") >= lo) & (F.col("feature_id") < hi))
        got = self.params.where(cond).select("feature_id", *self.slots).toArrow() if blocks else None
        out = {}
        for slot in self.slots if blocks else ():
            of = dict(zip(got.column("feature_id").to_pylist(), got.column(slot).to_pylist()))
            out |= {(slot, b.offset): [float(of.get(i) or 0.0) for i in range(b.offset, b.end)] for b in blocks}
        return out

    def of(self, segment: Segment, slot: str) -> list[list[float]]:
        known = self.all if self.all is not None else self._read(segment.blocks)
        return [known[slot, b.offset] for b in segment.blocks]

    def strengths(self, segment: Segment, slot: str, reg: float) -> float | list[list[float]]:
        """``reg``, or the features' own where the parameter table has them."""
        column = strength_column(slot)
        return self.of(segment, column) if column in self.slots else reg


def joined_ranges(blocks: list[Block]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b in sorted(blocks, key=lambda b: b.offset):
        if out and out[-1][1] == b.offset:
            out[-1] = (out[-1][0], b.end)
        else:
            out.append((b.offset, b.end))
    return out


class Work:
    """The rows' state within a pass: ``row_id, keys, e``, the factor sums that are at hand
    (``q0`` ..) and the columns of the segment table that was read last.  ``table``: the one
    segment table, whose columns the state holds throughout; nothing is joined by row id
    then, and the rows lie as they come."""

    def __init__(self, scratch: Scratch, parts: int, state: DataFrame, keys: tuple[str, ...] = (),
                 table: DataFrame | None = None):
        self.scratch, self.parts, self.start, self.keys = scratch, parts, state, keys
        self.frame, self.table, self.pending, self.path = state, table, 0, None
        self.waiting = 0            # rows of the tables of changes that the pending joins broadcast
        self.held = None if table is None else [c for c in table.columns if c in state.columns and c != "row_id"]

    def slim(self, q: str | None) -> DataFrame:
        """The state without segment columns: all sums while nothing was written yet."""
        sums = [c for c in self.frame.columns if c[0] == "q"] if self.path is None else [q] if q else []
        return self.frame.select("row_id", *self.keys, "e", *sums)

    def write(self, q: str | None, placed: bool = True) -> None:
        if self.held is not None:       # with the sums of this family and of those to come
            sums = [c for c in sum_columns(self.frame) if q is None or int(c[1:]) >= int(q[1:])]
            self.frame = self.scratch.write(self.frame.select("row_id", *self.keys, "e", *sums, *self.held), "state")
            if self.path:
                self.scratch.drop(self.path)
            self.path, self.pending, self.waiting = self.scratch.last(), 0, 0
            return
        keep = self.frame.select("row_id", *self.keys, "e", *([q] if q else []))
        self.frame = self.scratch.place(keep, "row_id", self.parts, "state", placed=placed)
        if self.path:
            self.scratch.drop(self.path)
        self.path, self.table, self.pending = self.scratch.last(), None, 0

    def with_sums(self, q: str | None) -> None:
        if q and q not in self.frame.columns:
            self.frame = placed_join(self.frame, self.start.select("row_id", q))

    def on(self, segment: Segment, q: str | None) -> DataFrame:
        """The state with the segment's columns (and ``q``)."""
        self.with_sums(q)
        if self.pending >= PENDING:
            self.write(q)
        if self.table is not segment.table:
            self.frame, self.table = placed_join(segment.table, self.slim(q)), segment.table
        return self.frame

    def changed(self, frame: DataFrame) -> None:
        self.frame, self.pending = frame, self.pending + 1

    def joined(self, q: str | None, rows: int) -> None:
        """A wide block's ``rows`` changes were joined: the state is written, unless it holds
        all columns and the broadcasts of all waiting joins are within the bound in sum."""
        spark = self.scratch.spark
        self.waiting += rows
        if self.held is None or not fits_broadcast(spark, self.waiting, 24 * self.waiting):
            # a join above the broadcast bound has moved the rows
            self.write(q, placed=fits_broadcast(spark, rows, 24 * rows))


def segment_step(work: Work, segment: Segment, params: DataFrame, values: Values, slot: str, reg: float,
                 updates: Updates) -> None:
    """The new values of a segment's blocks, and the rows changed by them."""
    factor = slot != "w"
    q = f"q{slot[1:]}" if factor else None
    frame = work.on(segment, q)
    if not segment.wide(frame.sparkSession):
        run = gram.Run(segment.blocks, segment.constants, values.of(segment, slot), segment.at)
        read = frame.withColumn("_r", gram.outside(run, F.col(q))) if factor else frame
        cells = gram.collected(gram.cell_sums(read, run, factor, gram.row_moments(F.col("_r") if factor else None)), run, factor)
        new = gram.solve(run, cells, values.strengths(segment, slot, reg), factor)
        updates.add_run(slot, run, new)
        work.changed(gram.changed_rows(frame, run, new, factor, q or ""))
        return
    block, j = segment.blocks[0], segment.at[0]
    frame = frame.withColumnRenamed(q, "q") if factor else frame
    delta = updates.scratch.write(theta_update(theta_stats(frame, params, j, block, slot), reg), "delta")
    updates.add_table(slot, delta)
    rows = delta_rows(delta, block)
    frame = error_update(frame, delta, j, block, factor, rows)
    work.changed(frame.withColumnRenamed("q", q) if factor else frame)
    work.joined(q, rows)


def sweep(work: Work, segments: list[Segment], params: DataFrame, values: Values, slot: str, reg: float,
          updates: Updates) -> None:
    """All blocks of one parameter family, ascending ids."""
    for segment in segments:
        segment_step(work, segment, params, values, slot, reg, updates)


@dataclass
class BlockStep:
    """One block of one family in order: its statistics, its changes, the state after it
    (``row_id, e`` and, for a factor, ``q``)."""
    slot: str
    number: int
    stats: DataFrame
    delta: DataFrame
    state: DataFrame


def block_by_block(train: Training, start: PassState, params: DataFrame, cfg: FMConfig) -> Iterator[BlockStep]:
    """A pass one block at a time, by tables only: what the sweeps do, open to inspection.
    The written tables belong to the training's scratch."""
    scratch = train.scratch
    state = start.errors
    for slot, reg in families(cfg):
        factor = slot != "w"
        if factor:
            state = placed_join(state, start.sums.select("row_id", F.col(f"q{slot[1:]}").alias("q")))
        keep = ["row_id", "e"] + ["q"] * factor
        blocks = [(seg, j, b) for seg in train.segments for j, b in zip(seg.at, seg.blocks)]
        for number, (seg, j, block) in enumerate(blocks):
            work = placed_join(seg.table, state)
            stats = scratch.write(theta_stats(work, params, j, block, slot), "stats")
            delta = scratch.write(theta_update(stats, reg), "delta")
            state = scratch.place(error_update(work, delta, j, block, factor).select(*keep), "row_id", train.parts, "state",
                                  placed=fits_broadcast(scratch.spark, block.size, 24 * block.size))
            yield BlockStep(slot, number, stats, delta, state)
        state = state.select("row_id", "e")


@dataclass
class IterationResult:
    params: DataFrame
    w0: float
    rmse_before: float


def families(cfg: FMConfig) -> list[tuple[str, float]]:
    """(slot, regularisation) of each parameter family, in order."""
    return ([("w", cfg.regw)] if cfg.k1 else []) + [(f"v{f}", cfg.regv) for f in range(cfg.k)]


def als_iteration(train: Training, params: DataFrame, w0: float, cfg: FMConfig, dimension: int) -> IterationResult:
    """One pass: residuals, w0, every w, then every v_f (ascending ids)."""
    mark = train.scratch.mark()
    table = one_table(train.segments)
    start = start_pass(train, params, w0, cfg, dimension, table)
    updates, work = Updates(train.scratch), Work(train.scratch, train.parts, start.state, table=table)
    todo = families(cfg)
    values = Values(params, train.segments, [slot for slot, _ in todo])
    for slot, reg in todo:
        sweep(work, train.segments, params, values, slot, reg, updates)
    made = train.scratch.paths[mark:]
    params = train.scratch.write(updates.apply(params, dimension), "params")
    for path in made:
        train.scratch.drop(path)
    return IterationResult(params, start.w0, start.rmse)


def fit(rows, cfg: FMConfig, dimension: int | None = None, blocks: list[Block] | None = None,
        learner=None, params: DataFrame | None = None, w0: float = 0.0,
        scratch: Scratch | None = None, order: str = "ascending", max_blocks: int | None = None,
        groups: DataFrame | None = None, group_reg: dict[int, tuple[float, float]] | None = None) -> FMModel:
    """``FM(dataset, k, iterations).learnWith(learner)``: initialise, then
    iterate; the trace holds the training RMSE before each iteration.  Only
    the final parameter table is kept in the scratch folder.

    ``rows`` may also be a ``RelationalData`` (fact + side tables), which is fitted
    relation-level.  ``learner(training, params, w0, cfg, dimension)`` does one
    iteration; the default is exact coordinate descent on either kind of data.

    ``order="coloured"``: ``blocks`` may hold several ids of a row (a list field's
    uncut block); their ids are updated colour by colour (see ``blocks``), which is
    coordinate descent in another order, in far fewer steps.  ``order="damped"``: no
    blocks; each family is one step with a line search (see ``damped``).  ``max_blocks``
    refuses the exact orders where they would need more blocks than that.

    ``group_reg``: regularisation (of w, of v) by attribute group, in place of the
    model's; ``groups`` (``feature_id, group_id``) says which group a feature is in (a
    ``RelationalData`` has its own: one group for each leaf block)."""
    if group_reg is not None and order != "ascending":
        raise ValueError("strengths by group go with the ascending order")
    if order not in ("ascending", "coloured", "damped"):
        raise ValueError(f"unknown order {order!r}; ascending, coloured or damped")

    def refuse(n: int) -> None:
        if max_blocks is not None and n > max_blocks:
            raise ValueError(f"{n} blocks in {order} order, more than max_blocks={max_blocks}; "
                             "fit(order='coloured') needs fewer, fit(order='damped') none")

    relabelling = None
    if isinstance(rows, DataFrame):
        if dimension is None or (blocks is None and order != "damped"):
            raise ValueError("flat rows need their dimension and conflict-free blocks")
        if order == "ascending":
            refuse(len(blocks))
        scratch = scratch if scratch is not None else Scratch(rows.sparkSession, "als")
        mark = scratch.mark()
        if order == "coloured":
            relabelling = coloured_blocks(rows, blocks, scratch)
            refuse(len(relabelling.blocks))
            rows, blocks = relabelled(rows, relabelling), relabelling.blocks
        if order == "damped":
            from .damped import damped_iteration
            train, learner = prepare(rows, [], scratch), learner or damped_iteration
        else:
            train, learner = prepare(rows, blocks, scratch), learner or als_iteration
    else:
        from .relational import RelationalData, prepare_relational, relational_iteration
        if not isinstance(rows, RelationalData):
            raise TypeError("fit takes training rows or a RelationalData")
        if blocks is not None or order != "ascending":
            raise ValueError("a RelationalData brings its own blocks, in ascending order")
        if dimension not in (None, rows.dimension):
            raise ValueError(f"the data have {rows.dimension} features, not {dimension}")
        dimension = rows.dimension
        refuse(sum(len(getattr(x, "blocks", [x])) for x in rows.segments))
        scratch = scratch if scratch is not None else Scratch(rows.fact.sparkSession, "rel")
        mark = scratch.mark()
        train = prepare_relational(rows, scratch)
        learner = learner or relational_iteration
    spark = scratch.spark
    given = params is not None
    if not given:
        params = init_params(spark, dimension, cfg)
    if relabelling is not None:
        params = renumbered(params, relabelling)
    if group_reg is not None:
        if groups is None:
            if isinstance(rows, DataFrame):
                raise ValueError("strengths by group need the features' groups")
            groups = rows.groups()
        params = with_strengths(params, groups, group_reg, cfg, dimension)
    if not given or relabelling is not None or group_reg is not None:
        params = scratch.write(params, "params")
    own = None if given and relabelling is None and group_reg is None else scratch.last()
    trace = []
    for it in range(1, cfg.iterations + 1):
        res = learner(train, params, w0, cfg, dimension)
        params, w0 = res.params, res.w0
        trace.append((it, res.rmse_before))
        if own:
            scratch.drop(own)
        own = scratch.last()
    if relabelling is not None:
        params = scratch.write(renumbered(params, relabelling, back=True), "params")
        own = scratch.last()
    for path in scratch.paths[mark:]:
        if path != own:
            scratch.drop(path)
    params = params.drop("_regw", "_regv")
    return FMModel(w0, params, cfg, dimension, spark.createDataFrame(trace, "iteration bigint, rmse double"))
