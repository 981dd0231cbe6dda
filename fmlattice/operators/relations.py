"""Side tables (star schema): a fact column is a key into a dimension table
whose own fields are encoded by their own dictionaries.

Layout of a fact field that has a relation: its own one-hot block (the key's
dictionary, learned from the fact) followed by the relation's block.  A
matched row takes the relation's features instead of the key's one-hot
(``keep_key=True`` keeps both); an unmatched row keeps the one-hot.  Because
the two blocks have disjoint id ranges, a miss never shifts other fields' ids
(Q10 deviation).

A side table's own fields may be keys into further side tables (``Relation.relations``):
those are encoded first, and a side row that matches takes the features of the row it
points to, in a block of its own layout.  So a key's one-hot is replaced at every
level that has a row, and the ids of a whole chain of tables lie in one range of the
fact's layout.

Plan: one left equi-join per relation.  The dimension side is broadcast when
its exact row count is under the bound, otherwise both sides shuffle on the
key, with the fact's hot keys (by exact counts) salted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ENTRY_OVERHEAD_BYTES, Scratch
from .fields import IDENTITY, FieldSpec, split_target_inputs
from .vectorize import (FEATURES, Learned, Vectorized, _source_type, base_columns, salted_join, vectorize_base,
                        within_budget)


@dataclass
class Relation:
    """A side table; its single ``target`` field is the join key."""
    table: DataFrame
    specs: list[FieldSpec]
    on_duplicate: str = "error"      # or "first": keep the row with the smallest ``order_by``
    order_by: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)     # of its own key columns


@dataclass
class EncodedRelation:
    rows: DataFrame        # key, features (ids local to the relation), written
    vec: Vectorized
    key: str
    size: int              # exact number of keys
    entries: int = 0       # exact number of (feature, value) entries, for the size check


def dedupe_keys(table: DataFrame, key: str, on_duplicate: str, order_by: str | None) -> DataFrame:
    """Q12: the original silently kept whichever duplicate came last."""
    if on_duplicate == "error":
        dup = table.groupBy(key).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"side table has duplicate keys in {key!r}")
        return table
    if on_duplicate == "first":
        if not order_by:
            raise ValueError("on_duplicate='first' needs order_by")
        # the least row by order_by, then by all columns; combined before the shuffle
        least = F.min(F.struct(F.col(order_by).alias("_order"), F.struct(*table.columns).alias("_row")))
        return table.groupBy(F.col(key).alias("_key")).agg(least.alias("_least")).select("_least._row.*")
    raise ValueError(f"unknown on_duplicate policy {on_duplicate!r}")


def encode_relation(rel: Relation) -> EncodedRelation:
    """Encode a side table by its own dictionaries, keyed by its target."""
    key_spec, inputs = split_target_inputs(rel.specs)
    table = dedupe_keys(rel.table, key_spec.column, rel.on_duplicate, rel.order_by)
    dtypes = {s.column: _source_type(table, s.column) for s in rel.specs}
    base = table.select(F.col(key_spec.column).alias("row_id"), F.lit(0.0).alias("y"),
                        *[F.col(s.column).alias(f"_c{i}") for i, s in enumerate(inputs)])
    vec = vectorize_related(base, inputs, dtypes, encode_relations(inputs, rel.relations))
    rows = Scratch(table.sparkSession, "relation").write(vec.rows.select(F.col("row_id").alias("key"), "features"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("m")).first()
    return EncodedRelation(rows, vec, key_spec.column, int(r["n"]), int(r["m"] or 0))


def encode_relations(inputs: list[FieldSpec], relations: dict[str, Relation]) -> dict[int, EncodedRelation]:
    """The side tables by the position of their fact field."""
    index = {s.column: i for i, s in enumerate(inputs)}
    for col in relations:
        if col not in index or inputs[index[col]].kind != IDENTITY:
            raise ValueError(f"relation column {col!r} must be an identity field of the fact")
    return {index[c]: encode_relation(r) for c, r in relations.items()}


def same_key(frame: DataFrame, column: str, side: DataFrame, key: str) -> Column:
    """The one rule of equal keys: as they are if their types agree, else as text."""
    if dict(frame.dtypes)[column] == dict(side.dtypes)[key]:
        return F.col(column) == F.col(key)
    return F.col(column).cast("string") == F.col(key).cast("string")


def small_sides(spark, encoded: dict[int, EncodedRelation]) -> tuple[set, int]:
    """Which side tables a plan broadcasts, within the byte bound in sum, and their
    bytes (dictionaries share what is left)."""
    sides = {i: (e.size, 16 * e.entries) for i, e in encoded.items()}
    small = within_budget(spark, sides)
    return small, sum(sides[i][1] + sides[i][0] * ENTRY_OVERHEAD_BYTES for i in small)


def attach(frame: DataFrame, column: str, side: DataFrame, key: str, small: bool, hot: list[str] | None = None) -> DataFrame:
    """Left join of a side table by key: broadcast if ``small``, else shuffled, rows with
    a null key apart (they match nothing, and would meet in one task) and hot keys in
    several parts."""
    on = same_key(frame, column, side, key)
    if small:
        return frame.join(F.broadcast(side), on, "left")
    none = frame.where(F.col(column).isNull())
    blank = [F.lit(None).cast(t).alias(c) for c, t in side.dtypes]
    some = salted_join(frame.where(F.col(column).isNotNull()), side, on, F.col(column).cast("string"),
                       F.col(key).cast("string"), hot or [])
    return some.unionByName(none.select("*", *blank))


def substitution(encoded: dict[int, EncodedRelation], small: set, keep_key: bool = False):
    """Replaces (or, ``keep_key``, extends) the one-hot of each key that has a side row."""
    def substitute(frame: DataFrame, layout, hot: dict[int, list[str]]) -> DataFrame:
        for i, enc in encoded.items():
            shift = layout[i].offset + layout[i].blocks[0].size
            side = enc.rows.select(
                F.col("key").alias(f"_rk{i}"),
                F.transform("features", lambda e: F.struct(
                    (e["feature_id"] + F.lit(shift)).alias("feature_id"),
                    e["value"].alias("value"))).cast(FEATURES).alias(f"_r{i}"))
            frame = attach(frame, f"_c{i}", side, f"_rk{i}", i in small, hot.get(i))
            sub = F.concat(F.col(f"_a{i}"), F.col(f"_r{i}")) if keep_key else F.col(f"_r{i}")
            frame = frame.withColumn(f"_a{i}", F.when(F.col(f"_rk{i}").isNotNull(), sub).otherwise(F.col(f"_a{i}")))
        return frame

    return substitute


def vectorize_related(base: DataFrame, inputs: list[FieldSpec], dtypes: dict[str, str], encoded: dict[int, EncodedRelation],
                      keep_key: bool = False, learned: Learned | None = None, unseen: str = "skip") -> Vectorized:
    """``vectorize_base`` with side tables."""
    extra = {i: (e.vec.dimension, e.vec.blocks()) for i, e in encoded.items()}
    small, reserved = small_sides(base.sparkSession, encoded)
    return vectorize_base(base, inputs, dtypes, extra=extra, reserved=reserved, learned=learned, unseen=unseen,
                          substitute=substitution(encoded, small, keep_key) if encoded else None)


def relation_vectorize(df: DataFrame, specs: list[FieldSpec], relations: dict[str, Relation],
                       row_id: str | None = None, keep_key: bool = False, ids: bool = True) -> Vectorized:
    """Vectorize a fact table whose columns named in ``relations`` are keys
    into side tables, which may have side tables of their own."""
    _, inputs = split_target_inputs(specs)
    encoded = encode_relations(inputs, relations)
    base, dtypes = base_columns(df, specs, row_id, ids)
    vec = vectorize_related(base, inputs, dtypes, encoded, keep_key)

    def encode(other: DataFrame, unseen: str, learned: Learned | None = None) -> DataFrame:
        b, types = base_columns(other, specs, row_id, ids, target=False)
        return vectorize_related(b, inputs, types, encoded, keep_key, learned or vec.learned, unseen).rows

    vec.encoder = encode
    vec.inputs = inputs
    return vec


def relation_layout(vec: Vectorized) -> list[tuple[str, int, int]]:
    """Leaf blocks ``(name, offset, width)`` of a (relation) layout."""
    return [(b.name, b.offset, b.size) for b in vec.blocks()]
