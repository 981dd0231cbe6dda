"""Relation-level ("block structure") learning for star schemas.

A fact row i that matches side-table row b holds b's features, so in the flat
design every feature of b is repeated on each of its n_b fact rows.  Here the
side table's parameters are learned on its own rows from a per-row cache of
fact aggregates (Rendle, "Scaling Factorization Machines to Relational Data",
VLDB 2013):

    n_b = #fact rows, E_b = Σ e_i, C_b = Σ c_i, C2_b = Σ c_i², EC_b = Σ e_i c_i

with c_i = q_i − q_b (the part of q_i from the fact's own features).  For a
relation feature with value x in b and g = q_b − x·v:

    w:  Σh² = Σ_b x² n,               Σeh = Σ_b x E,          E += n x Δ
    v:  Σh² = Σ_b x²(g²n + 2gC + C2), Σeh = Σ_b x(gE + EC),   E += xΔ(gn + C),
        EC += xΔ(gC + C2),  q_b += xΔ

and at the end the fact rows get e_i += Δlin_b (w) or e_i += Δy_b + Δq_b·c_i,
q_i += Δq_b (v), y_b = ½(q_b² − Σ v²x²).  The updates equal the flat sweep in the same
(ascending id) order.

Three ways, by measured sizes, with one result:

* a side table of narrow blocks (its cells one run of ``gram``) takes part in the fact's
  own segments: its ids, a few small columns, are joined to the fact once per fit
  (broadcast under the checked size, else by one shuffle, hot keys salted), and its
  blocks are solved in the same job as the fact's.  No cache is built, and the facts
  never hold its features.  Where all side tables do so and all blocks are in one segment
  table, that table is all a pass reads: it has the targets, and the rows are not placed;
* narrow blocks of other side tables are solved by ``gram`` on the side rows, each
  weighted by its cache: one job for a segment;
* wide blocks are updated on the side rows block by block.

The cache needs no side value per fact row: n, Σe, Σq, Σq², Σeq are grouped by key
(combined before the shuffle, so a key held by a third of the facts is no single
task), joined to one row per key and shifted by q_b there.  Rows, entries and state
are placed as in ``als``; keys ride along with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, fits_broadcast, maybe_broadcast, segment_blocks
from . import als as A
from . import gram
from .blocks import conflict_free_blocks
from .fields import FieldSpec, split_target_inputs
from .model import FMConfig, FMModel, score_sums
from .relations import Relation, attach, encode_relations, small_sides
from .vectorize import FEATURES, HOT_SHARE, Block, salted_join, vectorize_base, base_columns


@dataclass
class RelationBlock:
    """A side table as a feature block: ``rows(key, features)`` with flat ids
    and the blocks of its fields, attached to fact column ``column``."""
    column: str
    field: int
    rows: DataFrame
    blocks: list[Block]
    size: int
    entries: int = 0

    def broadcast(self, side: DataFrame, columns: int, features: bool = False) -> DataFrame:
        """``side`` (one row per key) for a broadcast, if its measured size allows."""
        extra = self.size * 8 * columns + (16 * self.entries if features else 0)
        return maybe_broadcast(side, self.size, extra_bytes=extra)


@dataclass
class RelationalData:
    fact: DataFrame               # row_id, y, key_<field> (null on a miss), features (own + key one-hot on a miss)
    relations: list[RelationBlock]
    segments: list               # ascending: Block (fact level) or RelationBlock
    dimension: int
    layout: list

    def groups(self) -> DataFrame:
        """Attribute groups: ``feature_id, group_id`` (default: group = leaf block)."""
        spark = self.fact.sparkSession
        parts = [spark.range(b.offset, b.end).select(F.col("id").alias("feature_id"),
                                                      F.lit(j).cast("bigint").alias("group_id"))
                 for j, b in enumerate(b for f in self.layout for b in f.blocks)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def attribute_groups(data: RelationalData, groups: DataFrame | None = None) -> DataFrame:
    """``group_id, n_features`` (Q18: the count comes from a grouping, so the
    last group is not dropped)."""
    g = groups if groups is not None else data.groups()
    return g.groupBy("group_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_features"))


def relational_dataset(df: DataFrame, specs: list[FieldSpec], relations: dict[str, Relation],
                       row_id: str | None = None) -> RelationalData:
    """Fact rows keep their own features and the key of each matched side
    row; side rows keep theirs (flat ids, same layout as ``relation_vectorize``)."""
    target, inputs = split_target_inputs(specs)
    encoded = encode_relations(inputs, relations)
    extra = {i: (e.vec.dimension, e.vec.blocks()) for i, e in encoded.items()}
    base, dtypes = base_columns(df, specs, row_id)
    small, reserved = small_sides(df.sparkSession, encoded)
    rel_rows: dict[int, DataFrame] = {}

    def substitute(frame: DataFrame, layout, hot: dict[int, list[str]]) -> DataFrame:
        for i, enc in encoded.items():
            shift = layout[i].offset + layout[i].blocks[0].size
            rel_rows[i] = enc.rows.select(F.col("key"), F.transform("features", lambda e: F.struct(
                (e["feature_id"] + F.lit(shift)).alias("feature_id"), e["value"].alias("value")))
                .cast(FEATURES).alias("features"))
            frame = attach(frame, f"_c{i}", enc.rows.select(F.col("key").alias(f"key_{i}")), f"key_{i}", i in small,
                           hot.get(i))
            frame = frame.withColumn(f"_a{i}", F.when(F.col(f"key_{i}").isNotNull(), F.array().cast(FEATURES))
                                     .otherwise(F.col(f"_a{i}")))
        return frame

    vec = vectorize_base(base, inputs, dtypes, extra=extra, substitute=substitute,
                         carry=[f"key_{i}" for i in encoded], reserved=reserved)
    rels, segments = [], []
    for f in vec.layout:
        if f.index in encoded:
            enc = encoded[f.index]
            # a list field of the side table is cut on the side rows: any
            # conflict-free cut in ascending order gives the flat result
            rb = RelationBlock(f.column, f.index, rel_rows[f.index],
                               conflict_free_blocks(rel_rows[f.index], f.blocks[1:]), enc.size, enc.entries)
            rels.append(rb)
            segments.append(f.blocks[0])
            segments.append(rb)
        else:
            segments.extend(conflict_free_blocks(vec.rows, f.blocks))
    return RelationalData(vec.rows, rels, segments, vec.dimension, vec.layout)


def relational_dimension(data: RelationalData) -> int:
    return data.dimension


# ---- written training data -----------------------------------------------------

@dataclass
class SideTable:
    """A side table's rows and entries, written once: ``key, features`` and segments
    ``key, l0, x0, ...`` (all placed by key)."""
    block: RelationBlock
    rows: DataFrame
    segments: list[A.Segment]


@dataclass
class RelationalTraining:
    """Fact rows placed by row id; ``steps`` in flat order: a list of segments of fact rows,
    or a side table that is swept on its own rows.  ``table``: the one segment table
    (``row_id, y`` and all columns), if that is all there is to read; the rows are as given then."""
    rows: DataFrame               # row_id, y, features, key_*
    steps: list
    data: RelationalData
    parts: int
    scratch: Scratch
    paths: list[str] = field(default_factory=list)
    sides: list[SideTable] = field(default_factory=list)
    table: DataFrame | None = None

    def keys(self) -> tuple[str, ...]:
        """Key columns that the state has to carry."""
        return tuple(f"key_{s.block.field}" for s in self.steps if isinstance(s, SideTable))

    def segments(self) -> list[A.Segment]:
        return [x for s in self.steps for x in (s.segments if isinstance(s, SideTable) else s)]


def joins_facts(run: RelationBlock, segments: list[A.Segment]) -> bool:
    """Whether a side table's blocks are solved with the fact's: narrow and one run."""
    return len(segments) == 1 and not segments[0].wide(run.rows.sparkSession)


def side_fits(run: RelationBlock) -> bool:
    """Whether a joining side table's columns are broadcast."""
    return fits_broadcast(run.rows.sparkSession, run.size, run.size * 12 * len(run.blocks))


def prepare_relational(data: RelationalData, scratch: Scratch | None = None) -> RelationalTraining:
    scratch = scratch if scratch is not None else Scratch(data.fact.sparkSession, "rel")
    mark = scratch.mark()
    spark = data.fact.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides: list[SideTable] = []
    for run in data.segments:
        if isinstance(run, RelationBlock):
            side = scratch.place(run.rows.select("key", "features"), "key", parts, "side")
            segments = A.place_segments(side.withColumnRenamed("key", "row_id"), run.blocks, parts, scratch)
            sides.append(SideTable(run, side, segments))
    of = {id(t.block): t for t in sides}
    steps: list = []            # blocks solved on fact rows, as (block, its side table or None), or a side table
    for run in data.segments:
        table = of.get(id(run))
        if table is not None and not joins_facts(run, table.segments):
            steps.append(table)
            continue
        if not steps or isinstance(steps[-1], SideTable):
            steps.append([])
        steps[-1] += [(run, None)] if table is None else [(b, table) for b in table.segments[0].blocks]
    if len(steps) == 1 and isinstance(steps[0], list) and len(steps[0]) <= segment_blocks(spark):
        columns = ("row_id", "y", *[f"key_{rb.field}" for rb in data.relations])
        rows = data.fact
        if not all(side_fits(t.block) for t in sides):      # the keys are counted, too
            rows = scratch.write(rows.select(*columns, "features"), "given")
        # dealt out evenly: a state has as many files as the one it was made of
        one = segment_frame(rows, steps[0], ("row_id", "y"))[0].repartition(parts)
        segments = A.measured_segments(scratch.write(one, "segment"), [b for b, _ in steps[0]])
        if segments:
            return RelationalTraining(rows, [segments], data, parts, scratch, scratch.paths[mark:], sides,
                                      segments[0].table)
    rows, parts = A.place_rows(data.fact, scratch, tuple(f"key_{rb.field}" for rb in data.relations))
    steps = [s if isinstance(s, SideTable) else place_fact_segments(rows, s, parts, scratch) for s in steps]
    return RelationalTraining(rows, steps, data, parts, scratch, scratch.paths[mark:], sides)


def segment_frame(rows: DataFrame, part: list, columns: tuple[str, ...] = ("row_id",)) -> tuple[DataFrame, bool]:
    """``columns`` and the entries of fact-level blocks and of blocks of joining side tables,
    in order, and whether the rows stay where they are: the side tables' columns come by
    broadcast joins or, above the bound, by shuffles."""
    tables = {id(t): t for _, t in part if t is not None}.values()
    frame = rows.select(*columns, *{f"key_{t.block.field}" for t in tables},
                        *[c for j, (b, t) in enumerate(part) if t is None for c in A.entry_columns(b, j)])
    for table in tables:
        segment, key = table.segments[0], f"key_{table.block.field}"
        at = {b.offset: segment.at[i] for i, b in enumerate(segment.blocks)}
        side = segment.table.select(F.col("row_id").alias("_key"), *[
            F.col(f"{c}{at[b.offset]}").alias(f"{c}{j}") for j, (b, t) in enumerate(part) if t is table for c in "lx"])
        if side_fits(table.block):
            frame = frame.join(F.broadcast(side), F.col(key) == F.col("_key"), "left")
        else:
            none = frame.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(t).alias(c) for c, t in side.dtypes])
            frame = salted_join(frame.where(F.col(key).isNotNull()), side, F.col(key) == F.col("_key"), F.col(key),
                                F.col("_key"), hot_keys(rows, key)).unionByName(none)
        frame = frame.drop("_key", key)
    return frame, all(side_fits(t.block) for t in tables)


def hot_keys(rows: DataFrame, key: str) -> list:
    """Keys that more than a ``HOT_SHARE``-th of the rows hold: fewer than that many."""
    n = rows.count()
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count()
            .where(F.col("count") * HOT_SHARE > n).select(key).collect()]


def place_fact_segments(rows: DataFrame, blocks: list, parts: int, scratch: Scratch) -> list[A.Segment]:
    """Segments of fact-level blocks and of blocks of joining side tables, in order."""
    out: list[A.Segment] = []
    for part in A.cut_segments(blocks, segment_blocks(rows.sparkSession)):
        frame, stay = segment_frame(rows, part)
        placed = scratch.place(frame, "row_id", parts, "segment", placed=stay)
        path = scratch.last()
        segments = A.measured_segments(placed, [b for b, _ in part])
        if not segments:
            scratch.drop(path)
        out += segments
    return out


# ---- learning ----------------------------------------------------------------

def side_sums(side: DataFrame, params: DataFrame, cfg: FMConfig, dimension: int) -> DataFrame:
    """Per side row: ``key, lin, s_f, ss_f`` of its own features."""
    r = side.select(F.col("key").alias("row_id"), "features", F.lit(0.0).alias("y"))
    return score_sums(r, params, cfg, dimension).withColumnRenamed("row_id", "key")


def relational_residuals(data: RelationalData, rows: DataFrame, params: DataFrame, w0: float,
                         cfg: FMConfig, sides: dict[int, DataFrame] | None = None) -> DataFrame:
    """Fact state ``row_id, key_*, e, q*`` with the side rows' contributions joined in
    by key.  ``sides``: each side table's ``side_sums``, if they are at hand."""
    own = score_sums(rows, params, cfg, data.dimension)
    keys = [f"key_{rb.field}" for rb in data.relations]
    j = rows.select("row_id", "y", *keys).join(own.hint("merge"), "row_id", "left")
    lin = F.coalesce(F.col("lin"), F.lit(0.0))
    s = {f: F.coalesce(F.col(f"s{f}"), F.lit(0.0)) for f in range(cfg.k)}
    ss = {f: F.coalesce(F.col(f"ss{f}"), F.lit(0.0)) for f in range(cfg.k)}
    for rb in data.relations:
        i = rb.field
        rs = sides[i] if sides else side_sums(rb.rows, params, cfg, data.dimension)
        rs = rs.select(F.col("key").alias(f"_rkey{i}"), F.col("lin").alias(f"_rlin{i}"),
                       *[F.col(f"s{f}").alias(f"_rs{i}_{f}") for f in range(cfg.k)],
                       *[F.col(f"ss{f}").alias(f"_rss{i}_{f}") for f in range(cfg.k)])
        j = join_side(j, f"key_{i}", rb.broadcast(rs, 2 + 2 * cfg.k), f"_rkey{i}", rb, 2 + 2 * cfg.k)
        lin = lin + F.coalesce(F.col(f"_rlin{i}"), F.lit(0.0))
        for f in range(cfg.k):
            s[f] = s[f] + F.coalesce(F.col(f"_rs{i}_{f}"), F.lit(0.0))
            ss[f] = ss[f] + F.coalesce(F.col(f"_rss{i}_{f}"), F.lit(0.0))
    inter = F.lit(0.0)
    for f in range(cfg.k):
        inter = inter + F.lit(0.5) * (s[f] * s[f] - ss[f])
    pred = (A.number_literal(float(w0)) if cfg.k0 else F.lit(0.0)) + (lin if cfg.k1 else F.lit(0.0)) + inter
    return j.select("row_id", *keys, (pred - F.col("y")).alias("e"),
                    *[s[f].alias(f"q{f}") for f in range(cfg.k)])


def join_side(fact: DataFrame, key: str, side: DataFrame, side_key: str, rb: RelationBlock, columns: int) -> DataFrame:
    """Left join by key.  Where both sides shuffle, facts without a key are left out of
    the shuffle join and added back, so that they do not meet in one task."""
    if fits_broadcast(fact.sparkSession, rb.size, rb.size * 8 * columns):
        return fact.join(side, fact[key] == side[side_key], "left")
    some, none = fact.where(F.col(key).isNotNull()), fact.where(F.col(key).isNull())
    blank = [F.lit(None).cast(t).alias(c) for c, t in side.dtypes]
    return some.join(side, some[key] == side[side_key], "left").unionByName(none.select("*", *blank))


def relation_cache(state: DataFrame, rb: RelationBlock, params: DataFrame, factor: int | None,
                   dimension: int, side: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Per referenced side row: ``key, n, E, C, C2, EC, qb, ssb`` (for w only ``n, E``
    matter; the rest is 0).  ``state``: ``key_<field>, e`` and ``q<factor>`` or ``q``.
    ``sums``: the side table's ``side_sums``, if at hand."""
    key = F.col(f"key_{rb.field}")
    e, n = F.col("e"), F.count(F.lit(1)).cast("double").alias("n")
    st = state.where(key.isNotNull()).groupBy(key.alias("key"))
    if factor is None:
        return st.agg(n, F.sum(e).alias("E")).select(
            "key", "n", "E", *[F.lit(0.0).alias(c) for c in ("C", "C2", "EC", "qb", "ssb")])
    q = F.col("q" if "q" in state.columns else f"q{factor}")
    agg = st.agg(n, F.sum(e).alias("E"), F.sum(q).alias("Q"), F.sum(q * q).alias("QQ"), F.sum(e * q).alias("EQ"))
    if sums is None:
        one = FMConfig(k=1)
        v = params.select("feature_id", F.lit(0.0).alias("w"), F.col(f"v{factor}").alias("v0"))
        sums = side_sums(side if side is not None else rb.rows, v, one, dimension)
        sums = sums.select("key", F.col("s0").alias("qb"), F.col("ss0").alias("ssb"))
    else:
        sums = sums.select("key", F.col(f"s{factor}").alias("qb"), F.col(f"ss{factor}").alias("ssb"))
    j = agg.join(rb.broadcast(sums, 3), "key", "left")
    qb, ssb = F.coalesce(F.col("qb"), F.lit(0.0)), F.coalesce(F.col("ssb"), F.lit(0.0))
    m, Q, QQ = F.col("n"), F.col("Q"), F.col("QQ")
    return j.select("key", "n", "E", (Q - m * qb).alias("C"),
                    F.greatest(QQ - F.lit(2.0) * qb * Q + m * qb * qb, F.lit(0.0)).alias("C2"),
                    (F.col("EQ") - qb * F.col("E")).alias("EC"), qb.alias("qb"), ssb.alias("ssb"))


def _side_terms(x: Column, t: Column, factor: bool) -> tuple[Column, Column]:
    """Σh² and Σeh of one side row for a feature with value x and old value t."""
    n, E, C, C2, EC = (F.col(c) for c in ("n", "E", "C", "C2", "EC"))
    if not factor:
        return x * x * n, x * E
    g = F.col("qb") - x * t
    return x * x * (g * g * n + F.lit(2.0) * g * C + C2), x * (g * E + EC)


def _side_applied(rs: DataFrame, x: Column, t: Column, d: Column, factor: bool) -> list:
    n, E, C, C2, EC = (F.col(c) for c in ("n", "E", "C", "C2", "EC"))
    new = {}
    if not factor:
        new["E"] = E + n * x * d
        new["dlin"] = F.col("dlin") + x * d
    else:
        g = F.col("qb") - x * t
        new["E"] = E + x * d * (g * n + C)
        new["EC"] = EC + x * d * (g * C + C2)
        new["qb"] = F.col("qb") + x * d
        new["ssb"] = F.col("ssb") + ((t + d) * (t + d) - t * t) * x * x
    return [new[c].alias(c) if c in new else c for c in rs.columns]


def _side_segment_step(rs: DataFrame, segment: A.Segment, values: A.Values, slot: str, reg: float,
                       updates: A.Updates) -> DataFrame:
    """A segment of narrow side-table blocks: each side row stands for its facts, whose
    ``r`` is their own part of q plus the side row's part outside the segment."""
    factor = slot != "w"
    run = gram.Run(segment.blocks, segment.constants, values.of(segment, slot), segment.at)
    n, E, C, C2, EC = (F.col(c) for c in ("n", "E", "C", "C2", "EC"))
    if factor:
        rs, s = rs.withColumn("_s", gram.outside(run, F.col("qb"))), F.col("_s")
        moments = gram.Moments(n, C + n * s, C2 + F.lit(2.0) * s * C + n * s * s, E, EC + s * E)
    else:
        moments = gram.Moments(n, None, None, E, None)
    cells = gram.collected(gram.cell_sums(rs, run, factor, moments), run, factor)
    new = gram.solve(run, cells, values.strengths(segment, slot, reg), factor)
    updates.add_run(slot, run, new)
    for j in range(len(run.blocks)):
        if new[j] == run.thetas[j]:
            continue
        x = F.coalesce(F.col(f"x{run.at[j]}"), F.lit(0.0))
        old, change = run.thetas[j], [b - a for a, b in zip(run.thetas[j], new[j])]
        if run.blocks[j].size == 1:
            t, d = A.number_literal(old[0]), A.number_literal(change[0])
        else:
            at = F.col(f"l{run.at[j]}") + F.lit(1)
            t, d = (F.coalesce(F.element_at(A.array_literal(v, "double"), at), F.lit(0.0)) for v in (old, change))
        rs = rs.withColumns({"_x": x, "_t": t, "_d": d})
        rs = rs.select(*_side_applied(rs, F.col("_x"), F.col("_t"), F.col("_d"), factor)).drop("_x", "_t", "_d")
    return rs


def _side_wide_step(rs: DataFrame, params: DataFrame, j: int, blk: Block, slot: str, reg: float,
                    updates: A.Updates) -> DataFrame:
    """A wide side-table block: the terms are polynomials in the old value, so their
    coefficients are summed per feature before it is joined."""
    factor = slot != "w"
    x = F.col(f"x{j}")
    n, E, C, C2, EC, qb = (F.col(c) for c in ("n", "E", "C", "C2", "EC", "qb"))
    if factor:      # g = qb - x t
        sums = {"h0": x * x * (qb * qb * n + F.lit(2.0) * qb * C + C2), "h1": x * x * x * (qb * n + C),
                "h2": x * x * x * x * n, "e0": x * (qb * E + EC), "e1": x * x * E}
    else:
        sums = {"h0": x * x * n, "e0": x * E}
    st = (rs.where(F.col(f"l{j}").isNotNull())
          .groupBy((F.col(f"l{j}") + F.lit(blk.offset).cast("bigint")).alias("feature_id"))
          .agg(*[F.sum(c).alias(a) for a, c in sums.items()]))
    theta = params.where((F.col("feature_id") >= blk.offset) & (F.col("feature_id") < blk.end)) \
                  .select(*A.theta_columns(params, slot))
    st = st.join(maybe_broadcast(theta, blk.size, extra_bytes=16 * blk.size), "feature_id", "left")
    t = F.coalesce(F.col("theta"), F.lit(0.0))
    hh, eh = F.col("h0"), F.col("e0")
    if factor:
        whole = F.col("h0") + t * t * F.col("h2")
        hh = F.col("h0") - F.lit(2.0) * t * F.col("h1") + t * t * F.col("h2")
        none = hh <= F.lit(A.ROUNDING) * whole
        eh = F.when(none, F.lit(0.0)).otherwise(F.col("e0") - t * F.col("e1"))
        hh = F.when(none, F.lit(0.0)).otherwise(hh)
    stats = st.select("feature_id", t.alias("theta"), hh.alias("sum_hh"), eh.alias("sum_eh"),
                      *[c for c in st.columns if c == "reg"])
    delta = updates.scratch.write(A.theta_update(stats, reg), "delta")
    updates.add_table(slot, delta)
    d = delta.select((F.col("feature_id") - F.lit(blk.offset)).alias("_dl"), F.col("theta").alias("_dth"),
                     F.col("delta").alias("_dd"))
    key = F.col(f"l{j}").cast("bigint")
    if fits_broadcast(rs.sparkSession, blk.size, 24 * blk.size):
        d = F.broadcast(d)
    else:
        key = A.spread_null(key, F.col("key"))
    joined = rs.join(d, key == F.col("_dl"), "left")
    return joined.select(*_side_applied(rs, F.coalesce(x, F.lit(0.0)), F.coalesce(F.col("_dth"), F.lit(0.0)),
                                        F.coalesce(F.col("_dd"), F.lit(0.0)), factor))


def relation_sweep(train: RelationalTraining, side: SideTable, state: DataFrame, params: DataFrame, values: A.Values,
                   slot: str, reg: float, updates: A.Updates, sums: DataFrame) -> DataFrame:
    """Sweep one side table's blocks for one family; returns the fact state
    (``row_id, key_*, e``, and ``q`` for a factor) with the change propagated."""
    scratch, rb = train.scratch, side.block
    factor = None if slot == "w" else int(slot[1:])
    cache = relation_cache(state, rb, params, factor, train.data.dimension, sums=sums)
    keep = ["key", "n", "E", "C", "C2", "EC", "qb", "ssb", "qb0", "ssb0", "dlin"]
    rs = scratch.place(cache.withColumns({"qb0": F.col("qb"), "ssb0": F.col("ssb"), "dlin": F.lit(0.0)}),
                       "key", train.parts, "cache")
    for seg in side.segments:
        work = A.placed_join(rs, seg.table.withColumnRenamed("row_id", "key"), "key")
        if not seg.wide(rs.sparkSession):
            rs = _side_segment_step(work, seg, values, slot, reg, updates).select(*keep)
            continue
        before, blk = scratch.last(), seg.blocks[0]
        work = _side_wide_step(work, params, seg.at[0], blk, slot, reg, updates)
        rs = scratch.place(work.select(*keep), "key", train.parts, "cache",
                           placed=fits_broadcast(work.sparkSession, blk.size, 24 * blk.size))
        if "/cache-" in before:
            scratch.drop(before)
    kcol = f"key_{rb.field}"
    if factor is None:
        ch = rs.select(F.col("key").alias("_ck"), F.col("dlin").alias("_de"))
        j = join_side(state, kcol, rb.broadcast(ch, 2), "_ck", rb, 2)
        new = {"e": F.col("e") + F.coalesce(F.col("_de"), F.lit(0.0))}
    else:
        dy = F.lit(0.5) * ((F.col("qb") * F.col("qb") - F.col("ssb")) - (F.col("qb0") * F.col("qb0") - F.col("ssb0")))
        ch = rs.select(F.col("key").alias("_ck"), dy.alias("_dy"), (F.col("qb") - F.col("qb0")).alias("_dq"),
                       F.col("qb0").alias("_qb0"))
        j = join_side(state, kcol, rb.broadcast(ch, 4), "_ck", rb, 4)
        c = F.col("q") - F.coalesce(F.col("_qb0"), F.lit(0.0))
        new = {"e": F.col("e") + F.coalesce(F.col("_dy") + F.col("_dq") * c, F.lit(0.0)),
               "q": F.col("q") + F.coalesce(F.col("_dq"), F.lit(0.0))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def relational_family(train: RelationalTraining, work: A.Work, params: DataFrame, values: A.Values, slot: str,
                      reg: float, updates: A.Updates, sums: dict[int, DataFrame]) -> None:
    """One parameter family in flat order: segments on the fact state, the other side
    tables' blocks on their caches."""
    q = f"q{slot[1:]}" if slot != "w" else None
    for step in train.steps:
        if not isinstance(step, SideTable):
            A.sweep(work, step, params, values, slot, reg, updates)
            continue
        rb = step.block
        work.with_sums(q)
        if work.pending > 1:
            work.write(q)
        state = work.frame.select("row_id", *work.keys, "e", *([F.col(q).alias("q")] if q else []))
        state = relation_sweep(train, step, state, params, values, slot, reg, updates, sums[rb.field])
        work.changed(state.withColumnRenamed("q", q) if q else state)
        work.write(q, placed=fits_broadcast(state.sparkSession, rb.size, rb.size * 32))


def relational_start(train: RelationalTraining, params: DataFrame, w0: float,
                     cfg: FMConfig) -> tuple[A.PassState, dict[int, DataFrame]]:
    """Residuals and bias step of a pass, and each side table's sums (one scoring of
    its rows, shared by all families).  With one segment table, the rows are scored by its
    columns; no side table is scored or joined again."""
    data, scratch = train.data, train.scratch
    if train.table is not None:
        values = A.Values(params, train.segments(), [slot for slot, _ in A.families(cfg)])
        first = A.column_residuals(train.table, train.segments(), params, values, w0, cfg)
        return A.started(scratch.write(first, "rstate"), w0, cfg), {}
    sums = {s.block.field: scratch.place(side_sums(s.rows, params, cfg, data.dimension), "key", train.parts, "sums",
                                         placed=True) for s in train.sides}
    fits = all(fits_broadcast(scratch.spark, rb.size, rb.size * 8 * (2 + 2 * cfg.k)) for rb in data.relations)
    state = scratch.place(relational_residuals(data, train.rows, params, w0, cfg, sums), "row_id", train.parts,
                          "rstate", placed=fits)
    summary = A.state_summary(state)
    if cfg.k0:
        state, w0 = A.global_bias_step(state, w0, cfg, summary)
    keys = [f"key_{rb.field}" for rb in data.relations]
    return A.PassState(state.select("row_id", *keys, "e"), state.drop("e", *keys), w0, summary[2], state), sums


def relational_work(train: RelationalTraining, start: A.PassState) -> A.Work:
    if train.table is not None:
        return A.Work(train.scratch, train.parts, start.state, table=train.table)
    sums = A.sum_columns(start.state)
    return A.Work(train.scratch, train.parts, start.state.select("row_id", *train.keys(), "e", *sums), train.keys())


def relational_iteration(train: RelationalTraining, params: DataFrame, w0: float, cfg: FMConfig,
                         dimension: int | None = None) -> A.IterationResult:
    """One pass in the flat order; equals the flat pass."""
    scratch = train.scratch
    mark = scratch.mark()
    start, sums = relational_start(train, params, w0, cfg)
    updates, work = A.Updates(scratch), relational_work(train, start)
    todo = A.families(cfg)
    values = A.Values(params, train.segments(), [slot for slot, _ in todo])
    for slot, reg in todo:
        relational_family(train, work, params, values, slot, reg, updates, sums)
    made = scratch.paths[mark:]
    params = scratch.write(updates.apply(params, train.data.dimension), "params")
    for path in made:
        scratch.drop(path)
    return A.IterationResult(params, start.w0, start.rmse)


def relational_fit(data: RelationalData, cfg: FMConfig, params: DataFrame | None = None, w0: float = 0.0,
                   learner=None, scratch: Scratch | None = None) -> FMModel:
    return A.fit(data, cfg, learner=learner, params=params, w0=w0, scratch=scratch)
