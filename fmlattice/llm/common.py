"""Helpers shared by the operators: tables, written cut points, grouped Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fmlattice.session import delete_path, scratch_path

# White space as the byte-level rules here know it.  Java's \s is [ \t\n\x0B\f\r].
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_RUN = "[^\\x20\\x09-\\x0D]+"

# Rows (two longs each) up to which a decision table is broadcast; beyond, its join shuffles.
BROADCAST_ROWS = 500_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BYTES_AT_ONCE = 1 << 20         # text that the numpy helpers take at a time
ROWS_PER_FILE = 100_000         # of a table whose rows are known to be few
BATCH_BYTES = 4 << 20           # text of the batches that operators work on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a cut point
    that survives lost executors and is computed once.  ``rows``: a bound on its rows,
    if one is known; a small table is then written by few tasks, not as many files as
    the shuffle has partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        files = max(1, -(-rows // ROWS_PER_FILE))
        df = df.coalesce(files) if files < shuffle_partitions(spark) else df
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, t.written_to)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in used:
        name = "_" + name
    return name


def keep_decided(docs: DataFrame, fingerprint: Column, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` to keep, with its columns, by ``decisions`` (doc_id, fp,
    kept: one row for each row of ``docs``).

    Rows equal in id and fingerprint are repeats of one document: if one of them is
    kept, the least by all columns stays."""
    fp, k_id, k_fp = (free_name(docs, n) for n in ("fp", "of_id", "of_fp"))
    rows = written(decisions.groupBy(F.col("doc_id").alias(k_id), F.col("fp").alias(k_fp))
                   .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                   .where(~F.col("kept") | (F.col("n") > 1)), "decided", rows=docs.count())
    gone, repeats = rows.where("not kept").select(k_id, k_fp), rows.where("kept").select(k_id, k_fp)
    if rows.count() <= BROADCAST_ROWS:
        gone, repeats = F.broadcast(gone), F.broadcast(repeats)
    same = (F.col(fp) == F.col(k_fp)) & F.col("doc_id").eqNullSafe(F.col(k_id))
    out = docs.withColumn(fp, fingerprint).join(gone, same, "left_anti")
    if rows.where("kept").isEmpty():
        return out.select(docs.columns)
    one = (out.join(repeats, same, "left_semi").groupBy("doc_id", fp)
           .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out.join(repeats, same, "left_anti").select(docs.columns).unionByName(one)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, over batch borders.  The partition has
    to be sorted by them; one group is held at a time."""
    pending: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        first = tuple(table_.column(k)[0].as_py() for k in keys)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if pending and first != last:
            yield pa.concat_tables(pending)
            pending = []
        for a, b in zip(cuts, cuts[1:]):
            if a and pending:
                yield pa.concat_tables(pending)
                pending = []
            pending.append(table_.slice(a, b - a))
        last = tuple(table_.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if pending:
        yield pa.concat_tables(pending)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1000)) * GOLDEN) | np.uint64(1)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a string column holds about ``most`` bytes in each (one
    row at least): what is made from a batch stays small beside the batch itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def text_slices(column: pa.Array):
    """(first row, data, offsets) for runs of rows of about ``BYTES_AT_ONCE`` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + BYTES_AT_ONCE))
        b = min(max(b, a + 1), len(column))
        yield a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(hash, begin, end, text) of each run of word bytes in the texts
    data[offsets[i]:offsets[i + 1]]; places are in ``data``."""
    word = is_word[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]         # a text's first byte does not go on a word
    at = np.flatnonzero(begins)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    letters = np.flatnonzero(word)
    of_word = np.searchsorted(letters, at)
    size = np.diff(np.r_[of_word, len(letters)])
    place = np.arange(len(letters)) - np.repeat(of_word, size)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), np.uint64(0x20000100000001B5), np.uint64)])
    hashes = mix(np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * power[place], of_word)
                 + size.astype(np.uint64) * GOLDEN)
    return hashes, at, at + size, np.searchsorted(offsets, at, side="right") - 1
