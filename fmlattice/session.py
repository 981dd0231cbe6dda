"""Session helpers: building a session, the shared checkpoint folder, size limits.

Lineage is cut with ``DataFrame.checkpoint`` (reliable, shared storage), never
with a local checkpoint.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only when the session has none (tests, local runs) do
we create one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Largest number of rows we let a broadcast side have.  Every broadcast in the
# library is behind a check of an exact row count against this bound; larger
# sides go through a shuffle join instead.
DEFAULT_BROADCAST_ROWS = 2_000_000

# Largest dictionary numbered inside one task (a global window).  Larger ones
# use the range-partitioned numbering in ``operators.dictionary``.
DEFAULT_SINGLE_TASK_ROWS = 1_000_000


def build_session(master: str | None = None, app: str = "fmlattice",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings the library is written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  A cluster names a shared one in
    ``spark.checkpoint.dir``; only a local master gets a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and "
                             "all executors share")
        configured = tempfile.mkdtemp(prefix="fmlattice-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fmlattice-scratch/{name}-{uuid.uuid4().hex}"


# Blocks that the learner updates between two writes of the training state.
DEFAULT_SEGMENT_BLOCKS = 8


def segment_blocks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("fmlattice.segmentBlocks", str(DEFAULT_SEGMENT_BLOCKS))))


# Blocks at most this wide carry their old values and changes as array
# literals indexed by ``feature_id - block start`` (O(1) lookups, folded into
# the plan): no join and no broadcast job per block.
DEFAULT_LITERAL_BLOCK_ROWS = 4096


def literal_block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("fmlattice.literalBlockRows", str(DEFAULT_LITERAL_BLOCK_ROWS)))


# Cells (combinations of ids) of the narrow blocks that the learner solves in one job;
# their sums are collected.
DEFAULT_GRAM_CELLS = 65_536


def gram_cells(spark: SparkSession) -> int:
    return int(spark.conf.get("fmlattice.gramCells", str(DEFAULT_GRAM_CELLS)))


DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("fmlattice.broadcastBytes", str(DEFAULT_BROADCAST_BYTES)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("fmlattice.broadcastRows", str(DEFAULT_BROADCAST_ROWS)))


def single_task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("fmlattice.singleTaskRows", str(DEFAULT_SINGLE_TASK_ROWS)))


class Scratch:
    """Tables written into the shared checkpoint folder to cut lineage.

    A written-and-reread table has no lineage and fresh statistics (the
    size of its files); ``DataFrame.checkpoint`` keeps the original plan's
    estimates, which compound over the learner's chained joins.  Tables are
    deleted when the owner says they are no longer read."""

    def __init__(self, spark: SparkSession, prefix: str = "t"):
        self.spark = spark
        self.prefix = prefix
        self.paths: list[str] = []
        self.tables: dict[str, str] = {}     # path of a bucketed table -> its name

    def write(self, df, name: str | None = None):
        path = scratch_path(self.spark, name or self.prefix)
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def place(self, df, key: str, parts: int, name: str | None = None, placed: bool = False):
        """Write ``df`` bucketed by ``key``: tables placed by the same key and number of
        buckets join, and group by the key, without a shuffle.  ``placed``: the rows
        are already partitioned that way."""
        path = scratch_path(self.spark, name or self.prefix)
        table = f"fmlattice_{uuid.uuid4().hex}"
        df = df if placed else df.repartition(parts, key)
        df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
        self.paths.append(path)
        self.tables[path] = table
        return self.spark.table(table)

    def last(self) -> str:
        return self.paths[-1]

    def mark(self) -> int:
        return len(self.paths)

    def drop(self, path: str) -> None:
        """Delete one table."""
        if path in self.paths:
            self.paths.remove(path)
            table = self.tables.pop(path, None)
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_path(self.spark, path)

    def drop_before(self, mark: int, keep: tuple = ()) -> None:
        """Delete tables written before ``mark`` (except paths in ``keep``)."""
        for p in self.paths[:mark]:
            if p not in keep:
                self.drop(p)

    def drop_all(self, keep: tuple = ()) -> None:
        self.drop_before(len(self.paths), keep)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jpath, True)


# fixed per-row overhead of a broadcast hash relation
ENTRY_OVERHEAD_BYTES = 48


def maybe_broadcast(df, rows: int, spark=None, extra_bytes: int = 0):
    """Broadcast ``df`` only if its exact row count, and its size estimated from the
    rows' fixed overhead and the measured ``extra_bytes``, are under the bounds."""
    spark = spark or df.sparkSession
    return F.broadcast(df) if fits_broadcast(spark, rows, extra_bytes) else df


def fits_broadcast(spark: SparkSession, rows: int, extra_bytes: int = 0) -> bool:
    return rows <= broadcast_rows(spark) and extra_bytes + rows * ENTRY_OVERHEAD_BYTES <= broadcast_bytes(spark)
