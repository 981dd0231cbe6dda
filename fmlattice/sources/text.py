"""Text sources and sinks: delimited records and libFM sparse text.

libFM line: ``label SP index:value SP index:value ...``.  Blank lines and
lines starting with ``#`` are skipped.  The writer adds ``index_base`` (1 by
default) to each id and prints numbers compactly (``#`` or ``#.###``); the
reader subtracts its own ``index_base`` (0 by default), so the defaults shift
ids by one on a round trip, as the original does (Q13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format_compact, split_keep_java
from ..operators.vectorize import FEATURES, assign_row_ids


JVM_BLANKS = "".join(map(chr, range(33)))


def read_delimited(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """Lines -> ``fields array<string>`` split by a literal separator, with
    the JVM's rule for trailing empty pieces (Q23)."""
    return spark.read.text(path).select(split_keep_java(F.col("value"), sep).alias("fields"))


def write_delimited(df: DataFrame, path: str, sep: str = "::") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")) \
      .write.mode("overwrite").text(path)


def filter_comment_blank(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trim as the JVM does (all characters up to the blank, tabs too), then drop empty
    lines and ``#`` comments."""
    trimmed = F.btrim(F.col(col), F.lit(JVM_BLANKS))
    # as a generator of one row or none: a filter would be moved below the projection, and
    # a line trimmed once for each use
    kept = F.filter(F.array(trimmed), lambda t: (F.length(t) > 0) & ~F.startswith(t, F.lit("#")))
    return lines.select(F.explode(kept).alias(col))


def parse_libfm(lines: DataFrame, index_base: int = 0, col: str = "value") -> DataFrame:
    """Trimmed, filtered libFM lines -> ``y double, features``."""
    # split in a projection of its own, which is not merged with the one that uses it thrice
    split = lines.select(F.split(F.col(col), " ", -1).alias("_items"))
    items = F.col("_items")
    tail = F.filter(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
                    lambda t: F.length(t) > 0)
    ent = F.transform(F.transform(tail, lambda t: F.split(t, ":", -1)), lambda p: F.struct(
        (p[0].cast("bigint") - F.lit(index_base)).alias("feature_id"), p[1].cast("double").alias("value")))
    return split.select(items[0].cast("double").alias("y"), ent.cast(FEATURES).alias("features"))


def read_libfm(spark: SparkSession, path: str, index_base: int = 0,
               assign_ids: bool = True, min_partitions: int | None = None) -> DataFrame:
    """libFM text -> ``row_id, y, features``.  Row ids are drawn once and the
    rows checkpointed, so they are stable under re-computation.
    ``min_partitions``: deal the lines over so many partitions."""
    lines = spark.read.text(path)
    if min_partitions:
        lines = lines.repartition(min_partitions)
    parsed = parse_libfm(filter_comment_blank(lines), index_base)
    return assign_row_ids(parsed) if assign_ids else parsed


def libfm_dimension(rows: DataFrame, num_features: int = -1) -> int:
    """``num_features`` if positive, else the largest id seen (the vector
    length is this + 1).  One scalar reaches the driver."""
    if num_features > 0:
        return num_features
    r = rows.select(F.explode("features").alias("e")).agg(F.max("e.feature_id").alias("d")).first()
    return int(r["d"]) if r["d"] is not None else 0


def libfm_lines(rows: DataFrame, index_base: int = 1, precision: int | None = 3) -> DataFrame:
    """``y, features`` -> ``value`` text lines, ids ascending.  Numbers have at most
    ``precision`` decimals; None prints full doubles."""
    def num(c):
        return c.cast("string") if precision is None else format_compact(c, precision)
    ents = F.transform(F.sort_array("features"), lambda e: F.concat(
        (e["feature_id"] + F.lit(index_base)).cast("string"), F.lit(":"), num(e["value"])))
    line = F.concat_ws(" ", num(F.col("y")), F.array_join(ents, " "))
    return rows.select(F.rtrim(line).alias("value"))


def write_libfm(rows: DataFrame, path: str, index_base: int = 1, precision: int | None = 3) -> None:
    libfm_lines(rows, index_base, precision).write.mode("overwrite").text(path)
