"""Chat formatting of logged conversations, native DataFrame work only.

Logs hold snapshots: a conversation is often a prefix of a longer one.  Each turn
gets a hash of its place, role and text; the running XOR over a conversation's
turns (two independent 64-bit ones) identifies the prefix of each length.  A
conversation whose whole hash is a proper prefix hash of another one is dropped by
an anti-join; of equal ones the least id stays.  Only then are texts read again,
for the conversations that remain, and rendered.

Prefix hashes are made distinct before they are joined, so a first turn that a
third of all conversations share is one row there.  Turns are dealt by ranges of
(conversation, turn), so a conversation that holds a third of all rows is spread over
many tasks: places and running hashes are taken within a range and shifted by the
totals of the ranges before it.  Shuffles carry hashes, but for the texts of the
remaining conversations.  A rendered row has at most ``PART_TURNS`` turns; a longer
conversation gives several, numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

PART_TURNS = 1024               # turns of a rendered row

START, END = "<|im_start|>", "<|im_end|>"
# roles as other logs name them
ROLE_NAMES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant",
              "model": "assistant", "ai": "assistant", "function": "tool"}


def role_name(role: Column) -> Column:
    low = F.lower(F.trim(role))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.when(low == "", F.lit("user")).otherwise(F.coalesce(F.try_element_at(names, low), low))


def escaped(text: Column) -> Column:
    """A text cannot hold the marks that begin or end a turn."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role_name(role), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null role and text count as empty) and two hashes."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def placed(turns: DataFrame, *columns: str) -> DataFrame:
    """The turns (of conversations with an id) with place (from 1) and n (turns of the
    conversation), pid (their range) and ``columns``.  No task holds a whole
    conversation: each range is numbered by itself."""
    keys = ["conv_id", F.col("turn").asc_nulls_last(), "role", "h1", "h2", "tie"]
    ranged = written(
        turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "h1", "h2", *columns)
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys).drop("tie")
        .withColumns({"at": F.monotonically_increasing_id(), "pid": F.spark_partition_id()}), "chat-turns")
    here = W.partitionBy("conv_id", "pid").orderBy("at")
    conv = W.partitionBy("conv_id")
    before = (ranged.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("m"))
              .select("conv_id", "pid", F.sum("m").over(conv).alias("n"),
                      F.coalesce(F.sum("m").over(conv.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)),
                                 F.lit(0)).alias("skip")))
    return (ranged.withColumn("here", F.row_number().over(here)).join(before, ["conv_id", "pid"])
            .withColumn("place", F.col("here") + F.col("skip")).drop("here", "skip"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n (turns of the conversation), p1, p2: one row a turn."""
    marks = {"z1": F.xxhash64(F.col("place").cast("long"), "h1"), "z2": F.xxhash64(F.col("place").cast("long"), "h2")}
    marked = placed(turns).withColumns(marks)
    rolling = W.partitionBy("conv_id", "pid").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    before = (marked.groupBy("conv_id", "pid").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"))
              .select("conv_id", "pid", F.coalesce(F.bit_xor("t1").over(earlier), none).alias("b1"),
                      F.coalesce(F.bit_xor("t2").over(earlier), none).alias("b2")))
    many = (marked.withColumns({"r1": F.bit_xor("z1").over(rolling), "r2": F.bit_xor("z2").over(rolling)})
            .join(before, ["conv_id", "pid"])
            .select("conv_id", "place", "n", F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"),
                    F.col("r2").bitwiseXOR(F.col("b2")).alias("p2")))
    # a turn without conversation is a conversation of its own
    one = F.lit(1).cast("long")
    alone = (turns.where("conv_id IS NULL").select("conv_id", one.alias("place"), one.alias("n"), "h1", "h2")
             .withColumns(marks).select("conv_id", "place", "n", F.col("z1").alias("p1"), F.col("z2").alias("p2")))
    return many.unionByName(alone)


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n, p1, p2, copies: conversations that are no proper prefix of another;
    of equal ones the least id (null only if none has one)."""
    whole = (prefixes.where("place = n").groupBy("n", "p1", "p2")
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")))
    proper = prefixes.where("place < n").select(F.col("place").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti")


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Maximal conversations: conv_id, part (from 0), n_turns (of the conversation),
    copies (equal conversations, itself included), chat (rendered), n_chars.  One row
    for each, or one for every ``part_turns`` turns of a longer one.

    Turns are ordered by turn (nulls last), role, then a hash of role and text, so
    repeated rows are turns too.  Null roles and texts count as empty; an empty role
    is rendered as user.  A row with a null conv_id is a conversation of one turn.
    Other columns are ignored; an empty table gives no row."""
    turns = turns_of(conversations)
    chosen = written(maximal(prefix_hashes(turns)), "chat-chosen")
    known = chosen.where("conv_id IS NOT NULL").select("conv_id", F.col("n").alias("n_turns"), "copies")
    line = rendered_turn(F.col("role"), F.col("text")).alias("line")

    def joined(lines: DataFrame, turn: Column) -> DataFrame:
        return (lines.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
                .select("conv_id", "part", "n_turns", "copies", F.array_join("turns.line", "").alias("chat")))

    zero = F.lit(0).cast("long").alias("part")
    whole = joined(turns.join(known.where(F.col("n_turns") <= part_turns), "conv_id").withColumn("part", zero),
                   F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.col("role").alias("c"),
                            F.col("h1").alias("d"), F.col("h2").alias("e"), line))
    out = whole
    long = known.where(F.col("n_turns") > part_turns)
    if not long.isEmpty():
        ordered = placed(turns.join(long.select("conv_id"), "conv_id", "left_semi"), "text")
        part = F.floor((F.col("place") - 1) / part_turns).cast("long")
        out = out.unionByName(joined(ordered.join(long, "conv_id").withColumn("part", part),
                                     F.struct(F.col("place").alias("a"), line)))
    lone = (turns.where("conv_id IS NULL").groupBy("role", "text", "h1", "h2").agg(F.lit(1).alias("one"))
            .select("role", "text", F.xxhash64(F.lit(1).cast("long"), "h1").alias("p1"),
                    F.xxhash64(F.lit(1).cast("long"), "h2").alias("p2"))
            .join(chosen.where("conv_id IS NULL").select("p1", "p2", "n", "copies"), ["p1", "p2"])
            .select(F.lit(None).cast("long").alias("conv_id"), zero, F.col("n").alias("n_turns"), "copies",
                    rendered_turn(F.col("role"), F.col("text")).alias("chat")))
    return out.unionByName(lone).withColumn("n_chars", F.length("chat"))
