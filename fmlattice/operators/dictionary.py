"""Category dictionaries: distinct tokens -> dense ids in lexicographic order.

Two numbering paths give the same ids:

* a dictionary whose exact size is at most ``single_task_rows`` is numbered by
  a global ``row_number`` window (one task, bounded by the checked size);
* a larger one is range-partitioned on the token, sorted inside each
  partition, checkpointed (so the range bounds and positions are fixed), and
  numbered as partition start + position.  Only one count per partition
  reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import single_task_rows

ROWS_PER_RANGE = 4_000_000


def dense_ids(distinct: DataFrame, size: int | None = None, *,
              max_single_task: int | None = None) -> tuple[DataFrame, int]:
    """Number distinct ``token`` rows 0..n-1 in token order.
    Returns ``(DataFrame(token, code), n)``."""
    spark = distinct.sparkSession
    n = distinct.count() if size is None else size
    limit = single_task_rows(spark) if max_single_task is None else max_single_task
    if n <= limit:
        w = Window.orderBy("token")
        return distinct.select("token", (F.row_number().over(w) - 1).cast("bigint").alias("code")), n
    parts = max(2, -(-n // ROWS_PER_RANGE))
    ranged = (distinct.repartitionByRange(parts, "token")
              .sortWithinPartitions("token")
              .select("token",
                      F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid"))
              .checkpoint(eager=True))
    counts = sorted((r["_pid"], r["count"]) for r in ranged.groupBy("_pid").count().collect())
    starts, acc = [], 0
    for pid, c in counts:
        starts.append((pid, acc))
        acc += c
    start_df = spark.createDataFrame(starts, "_pid int, _start bigint")
    coded = ranged.join(F.broadcast(start_df), "_pid").select(
        "token",
        (F.col("_start") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)).alias("code"))
    return coded, n
