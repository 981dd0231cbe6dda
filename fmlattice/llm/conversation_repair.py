"""Conversation structure repair: the cheapest edits after which roles alternate.

Turns are edited (kept, given the other role, deleted, inserted) so that the role
initials read ``(s?(ua)+)?``; the audit names the edits in order, and of equally cheap
audits the least one is taken.  ``audit_dp`` has the dynamic program.

A conversation may hold a third of all rows, so none is one task's work:

* rows without their texts are dealt by range of (conversation, turn, role, hash of the
  text), which gives every row its place; whether a role and text were seen earlier is
  the least place of their hash, combined before the shuffle and joined by place;
* the program runs on chunks of ``CHUNK_TURNS`` places.  A conversation inside a chunk is
  solved there; of one that crosses its border, the chunk's part is solved from each
  state to each state.  What joins the parts are 16 numbers for each;
* the texts are read once more and follow the chosen audits in order.  Only this last
  step, a hash of a conversation's whole repaired text, reads a conversation in one
  task (a hash has no parts): a stream of rows sorted by Spark, none of them kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit_dp as dp
from .common import groups, shuffle_partitions, written

CHUNK_BITS = 12                 # 4,096 places are a chunk
CHUNK_TURNS = 1 << CHUNK_BITS

SOLID = "[^\\x20\\x09-\\x0D]"
ORDER = ["conv_id", "turn", "role", "h"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text counts as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged copies, by ``crc32("conv_id:turn") % 20`` (nulls are one space there): 0 drops
    a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    rows = turns_of(conversations).withColumn("c", F.crc32(key) % 20).where("c <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")).drop("n")


def text_hash() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


def placed(turns: DataFrame) -> DataFrame:
    """One row a turn without its text: ORDER, place (rising in that order), kind, blank,
    open (its last character is no end mark)."""
    kind = F.lit(dp.OTHER)
    for k, initial in enumerate("sua"):
        kind = F.when(F.col("role").startswith(initial), k).otherwise(kind)
    slim = turns.select("conv_id", "turn", "role", text_hash().alias("h"), kind.cast("int").alias("kind"),
                        (~F.col("text").rlike(SOLID)).alias("blank"),
                        (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("open"))
    return written(slim.repartitionByRange(shuffle_partitions(turns.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
                   .withColumn("place", F.monotonically_increasing_id()), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """``placed`` turns with chunk and fault."""
    first = turns.groupBy("conv_id", "role", "h").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    fault = (F.when(F.col("blank"), dp.BLANK).when(F.col("new").isNull(), dp.DUPLICATE)
             .when(F.col("open"), dp.TRUNCATED).otherwise(dp.FINE))
    return turns.join(first, "place", "left").select(
        F.shiftright("place", CHUNK_BITS).alias("chunk"), "place", *ORDER, "kind", fault.cast("int").alias("fault"))


PIECE = ("conv_id long, turn long, role string, h binary, place long, done boolean, "
         "blank long, duplicate long, truncated long, illegal long, first int, last int, "
         "cost long, audit string, costs array<long>, audits array<string>, ranks array<int>")


def solve_chunks(rows: DataFrame) -> DataFrame:
    """One row for each conversation of each chunk: where it begins there, its counts and,
    if it lies within the chunk (``done``), cost and audit, else the ways through it."""

    def piece(t: pa.Table, a: int, b: int, edge: bool, kinds: list, faults: list) -> dict:
        turns = list(zip(kinds[a:b], faults[a:b]))
        out = {c: t.column(c)[a].as_py() for c in ("conv_id", "turn", "role", "h", "place")}
        out |= {"done": not edge, "first": kinds[a], "last": kinds[b - 1],
                "blank": faults[a:b].count(dp.BLANK), "duplicate": faults[a:b].count(dp.DUPLICATE),
                "truncated": faults[a:b].count(dp.TRUNCATED),
                "illegal": sum(x not in dp.ADJACENT for x in zip(kinds[a:b], kinds[a + 1:b]))}
        if edge:
            out["costs"], out["audits"], out["ranks"] = dp.ways(turns, first=False)
        else:
            out["cost"], out["audit"] = dp.whole(turns)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for t in groups(batches, ["chunk"]):
            convs, kinds, faults = (t.column(c).to_pylist() for c in ("conv_id", "kind", "fault"))
            cuts = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]] + [len(convs)]
            out = [piece(t, a, b, a == 0 or b == len(convs), kinds, faults) for a, b in zip(cuts, cuts[1:])]
            schema = schema or pa.schema([
                ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary()),
                ("place", pa.int64()), ("done", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                ("cost", pa.int64()), ("audit", pa.string()), ("costs", pa.list_(pa.int64())),
                ("audits", pa.list_(pa.string())), ("ranks", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "place")
    return dealt.mapInArrow(run, PIECE)


def joined(pieces: DataFrame) -> DataFrame:
    """``place, pick, closing`` of the pieces that cross, or end at, a chunk's border."""
    def numbers(values) -> list[int | None]:
        return [None if x is None or x != x else int(x) for x in values]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        picks, closing = dp.chosen([(numbers(c), numbers(r)) for c, r in zip(t["costs"], t["ranks"])])
        return pd.DataFrame({"place": t["place"], "pick": picks, "closing": [""] * (len(t) - 1) + [closing]})

    return (pieces.where("not done").select("conv_id", "place", "costs", "ranks").groupBy("conv_id")
            .applyInPandas(run, "place long, pick int, closing string"))


def audits(turns: DataFrame) -> DataFrame:
    """The audit of every conversation, one row for each chunk that it touches, with the
    key of its first turn there."""
    pieces = written(solve_chunks(judged(placed(turns))), "pieces")
    picks = joined(pieces)
    at = F.col("pick") + 1
    return pieces.join(picks, "place", "left").select(
        *ORDER, "place", "blank", "duplicate", "truncated", "illegal", "first", "last",
        F.when(F.col("done"), F.col("cost")).otherwise(
            F.get("costs", F.col("pick")) + F.length("closing") * F.lit(dp.INSERT_COST)).alias("cost"),
        F.when(F.col("done"), F.col("audit")).otherwise(
            F.concat(F.element_at("audits", at), F.col("closing"))).alias("audit"))


class Follow:
    """The turns of one conversation edited by its audit, which arrives in parts, each no
    later than its first turn."""

    NAMES = {2: "user", 3: "assistant"}
    KINDS = {"s": dp.SYSTEM, "u": dp.USER, "a": dp.ASSISTANT}

    def __init__(self):
        self.state, self.left, self.at, self.more = 0, "", 0, []

    def add(self, audit: str) -> None:
        self.more.append(audit)

    def _next(self) -> str:
        while self.at == len(self.left) and self.more:
            self.left, self.at = self.more.pop(0), 0
        return self.left[self.at] if self.at < len(self.left) else ""

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self._next() == "I":
            self.at += 1
            self.state = dp.FILLED[self.state]
            yield self.NAMES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands in the place of one more turn."""
        yield from self.inserts()
        letter = self._next()
        self.at += 1
        if letter == "K":
            self.state = dp.KEPT[self.state, self.KINDS[role[0]]]
            yield role, text
        elif letter == "R":
            self.state = dp.FILLED[self.state]
            yield self.NAMES[self.state], text


RESULT = ("conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
TURNS = "conv_id long, position long, role string, text string"
COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def followed(turns: DataFrame, edits: DataFrame, with_turns: bool) -> DataFrame:
    """The texts in order behind their audits: a row a conversation (RESULT) or, with
    ``with_turns``, the repaired turns (TURNS)."""
    edit_columns = [*COUNTS, "first", "last", "audit", "place"]
    types = dict(edits.dtypes)
    texts = turns.withColumn("h", text_hash()).select(
        *ORDER, F.lit(1).alias("what"), "text", *[F.lit(None).cast(types[c]).alias(c) for c in edit_columns])
    both = edits.select(*ORDER, F.lit(0).alias("what"), F.lit(None).cast("string").alias("text"), *edit_columns).unionByName(texts)
    dealt = both.repartition("conv_id").sortWithinPartitions(*ORDER, "what", "place").drop("turn", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, follow = None, None

        def begun(conv_id):
            return {"id": conv_id, "sum": dict.fromkeys(COUNTS, 0), "last": None, "audit": [], "n": 0,
                    "sha": hashlib.sha256()}, Follow()

        def take(edited, rows):
            for role, text in edited:
                if with_turns:
                    rows.append((conv["id"], conv["n"], role, text))
                else:
                    conv["sha"].update(f"{chr(10) if conv['n'] else ''}{role}:{text}".encode())
                conv["n"] += 1

        def ended(rows):
            take(follow.inserts(), rows)
            if not with_turns:
                rows.append((conv["id"], *(conv["sum"][c] for c in COUNTS), "".join(conv["audit"]), conv["sha"].hexdigest()))

        def frame(rows):
            names = ["conv_id", "position", "role", "text"] if with_turns else ["conv_id", *COUNTS, "audit", "repaired_sha256"]
            kinds = ([pa.int64(), pa.int64(), pa.string(), pa.string()] if with_turns else
                     [pa.int64()] * 6 + [pa.string(), pa.string()])
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            rows: list = []
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if conv is None or cols["conv_id"][i] != conv["id"]:
                    if conv is not None:
                        ended(rows)
                    conv, follow = begun(cols["conv_id"][i])
                if cols["what"][i]:
                    take(follow.turn(cols["role"][i], cols["text"][i]), rows)
                    continue
                follow.add(cols["audit"][i])
                if not with_turns:
                    conv["audit"].append(cols["audit"][i])
                for c in COUNTS:
                    conv["sum"][c] += cols[c][i]
                if conv["last"] is not None and (conv["last"], cols["first"][i]) not in dp.ADJACENT:
                    conv["sum"]["illegal"] += 1
                conv["last"] = cols["last"][i]
            if rows:
                yield frame(rows)
        if conv is not None:
            rows = []
            ended(rows)
            yield frame(rows)

    return dealt.mapInArrow(run, TURNS if with_turns else RESULT)


def gaps(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turn numbers missing between the least and the largest one."""
    per = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("turn").alias("n"))
    return per.select("conv_id", F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated (turns by their first
    fault), illegal (neighbours whose initials are not su, ua or au), cost, audit (K keep,
    R give the other role, D delete, I insert) and repaired_sha256 (of the repaired
    ``role:text`` lines).  ``ids``: conversations to return besides those with turns; one
    without turns has zeros, an empty audit and the hash of nothing.

    Turns are taken by turn (nulls first), then role, then SHA-256 of the text, so
    repeated rows are neighbours.  Null roles and texts count as one space; an empty role
    has no initial and is not kept.  Rows with
    a null conv_id are one conversation.  Other columns are ignored; an empty table
    gives no row."""
    rows = turns_of(turns)
    found = followed(rows, audits(rows), with_turns=False)
    known = rows.select("conv_id") if ids is None else rows.select("conv_id").union(ids.select(F.col("conv_id").cast("long")))
    known = known.distinct()

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "_conv")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    out = attach(attach(known, gaps(rows)), found)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    rows = turns_of(turns)
    return followed(rows, audits(rows), with_turns=True)
