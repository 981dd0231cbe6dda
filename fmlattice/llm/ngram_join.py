"""N-gram Jaccard join by MinHash banding.

Words are runs of characters other than ASCII white space; a text's set is that
of its 64-bit hashed n-grams of words (all words, if they are fewer than n).

1. A scan computes each text's set digest, set size and band hashes; bands and
   rows are chosen for a target recall at the threshold.
2. Texts with equal sets are one class: one representative, a number of copies.
3. Band hashes shuffle.  A bucket is its members' representatives; buckets with
   the same members are one (by an order-free digest), so a pair found in
   many bands is not looked at as often.
4. Buckets of more than a block have a pivot, their least member.  Members whose full
   sets are within half the threshold's distance of a pivot are its ball: Jaccard
   distance is a metric, so all pairs of a ball are links, known without a look at
   them.  A member is compared with one pivot only, the one in most of its buckets.
5. Buckets are cut into blocks of bounded rows and n-grams, a large ball into blocks of
   its own; a task gets two blocks of one bucket with the full sets, and verifies the
   pairs between them.  Blocks of one ball do not meet, so a bucket of close copies is
   no block pair.  A pair belongs to the least bucket that both sides share, so it
   counts once.  The task returns, for each member, its number of links and an edge of
   a spanning forest, never the pairs: a bucket of m members returns O(m) rows.
6. Links add up; forest edges give the components.

A bucket that a third of all texts share, but not as close copies, is many block pairs,
in as many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import (GOLDEN, discard, groups, keep_decided, mix, seeds, shuffle_partitions, text_batches, text_slices,
                     word_spans, written)
from .components import components

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 160
BLOCK_ROWS = 256                # members of a block of a bucket
BLOCK_GRAMS = 400_000           # n-grams of a block, but for single larger sets
BROADCAST_IDS = 1_000_000       # representatives (a long each) that a scan may be sent
NO_BALL = -1                    # nodes are not negative
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
                 max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows (fewest false candidates) whose bands reach the
    recall at the threshold within the number of hashes.  Raises where none does."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"threshold {threshold} and recall {recall} have to be above 0, recall below 1, threshold at most 1")
    best = None
    for rows in range(1, 17):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        need = math.ceil(math.log1p(-recall) / math.log1p(-threshold))
        raise ValueError(f"a recall of {recall} at a threshold of {threshold} takes {need} hashes: "
                         f"max_hashes is {max_hashes}")
    return best


def gram_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of the texts data[offsets[i]:offsets[i + 1]], and
    where each text's hashes begin (length texts + 1)."""
    texts = len(offsets) - 1
    hashes, at, _, _ = word_spans(data, offsets, NOT_SPACE)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    first = np.searchsorted(at, offsets)                # first word of each text
    n_words = np.diff(first)
    n_grams = np.where(n_words >= n, n_words - n + 1, (n_words > 0).astype(np.int64))
    starts = np.r_[0, np.cumsum(n_grams)]
    text_of = np.repeat(np.arange(texts), n_grams)
    index = first[text_of] + np.arange(starts[-1]) - starts[text_of]
    k = seeds(n, 7)
    none = k * np.arange(1, n + 1, dtype=np.uint64)     # stands for a word past the text's end
    out = np.zeros(len(index), np.uint64)
    left = n_words[text_of] - (index - first[text_of])  # words from here to the text's end
    for j in range(n):
        there = left > j
        out += np.where(there, hashes[np.minimum(index + j, len(hashes) - 1)] * k[j], none[j])
    return mix(out), starts


def distinct_grams(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's n-grams sorted and distinct, and where they begin."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner = owner[new]
    return grams[new], np.searchsorted(owner, np.arange(len(starts)))


def set_digests(grams: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each text's set; 0 for an empty one."""
    full = np.flatnonzero(np.diff(starts))
    h1, h2 = np.zeros(len(starts) - 1, np.uint64), np.zeros(len(starts) - 1, np.uint64)
    if len(full):
        h1[full] = np.add.reduceat(mix(grams + GOLDEN), starts[:-1][full])
        h2[full] = np.add.reduceat(mix(grams ^ GOLDEN), starts[:-1][full])
    return h1, h2


def signature_rows(n: int, bands: int, rows: int):
    """Arrow function: (doc_id, text, fp) -> (doc_id, fp, h1, h2, n_grams, bands)."""
    xor, times, salt = seeds(bands * rows, 1), seeds(bands * rows, 2), seeds(bands, 3)

    def one(grams, starts):
        full = np.flatnonzero(np.diff(starts))
        h1, h2 = set_digests(grams, starts)
        hashes = np.zeros((bands, len(starts) - 1), np.uint64)
        if len(full):
            at = starts[:-1][full]
            for b in range(bands):
                h = np.full(len(full), salt[b])
                for r in range(b * rows, (b + 1) * rows):
                    h = mix(h ^ np.minimum.reduceat((grams ^ xor[r]) * times[r], at))
                hashes[b, full] = h
        return h1, h2, np.diff(starts), hashes

    def run(batches):
        for batch in text_batches(batches, 1):
            parts = []
            for _, data, offsets in text_slices(batch.column(1)):
                parts.append(one(*distinct_grams(*gram_hashes(data, offsets, n))))
            if not parts:
                continue
            h1, h2, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
            hashes = np.concatenate([p[3] for p in parts], axis=1)
            flat = np.ascontiguousarray(hashes.T).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * bands, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array(size, pa.int64()), lists], names=["doc_id", "fp", "h1", "h2", "n_grams", "bands"])

    return run


def gram_rows(n: int):
    """Arrow function: (doc_id, text) -> (doc_id, h1, h2, grams): the sorted set as bytes."""

    def run(batches):
        for batch in text_batches(batches, 1):
            out, h1, h2 = [], [], []
            for _, data, offsets in text_slices(batch.column(1)):
                grams, starts = distinct_grams(*gram_hashes(data, offsets, n))
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    out.append(grams[a:b].tobytes())
                d1, d2 = set_digests(grams, starts)
                h1.append(d1)
                h2.append(d2)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(h1).view(np.int64)),
                     pa.array(np.concatenate(h2).view(np.int64)), pa.array(out, pa.binary())],
                    names=["doc_id", "h1", "h2", "grams"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of the sets (sorted, distinct)."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    column = np.cumsum(np.r_[0, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    times = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    many = times > 1                    # an n-gram of one member is in no intersection
    column, owner = (np.cumsum(many) - 1)[column[many[column]]], owner[many[column]]
    n = int(many.sum())
    cut = np.searchsorted(column, np.arange(0, n + 4096, 4096))
    total = np.zeros((m, m), np.float32)
    for k in range(len(cut) - 1):
        a, b = cut[k], cut[k + 1]
        if a < b:
            here = np.zeros((m, min(4096, n - 4096 * k)), np.float32)
            here[owner[a:b], column[a:b] - 4096 * k] = 1
            total += here @ here.T
    return np.rint(total).astype(np.int64)


def in_thousandths(threshold: float) -> int:
    """The threshold as similarities are compared with it, in integers only."""
    return round(threshold * 1000)


def near_rows(threshold: float):
    """Arrow function over rows sorted by (pivot, chunk), the pivot's own among them:
    (node, pivot) where the similarity is at least halfway between threshold and 1."""
    t = in_thousandths(threshold)

    def run(batches):
        for g in groups(batches, ["pivot", "chunk"]):
            pivot = g.column("pivot")[0].as_py()
            g = g.combine_chunks()
            node = g.column("node").to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in g.column("grams").to_pylist()]
            own = sets[int(np.flatnonzero(node == pivot)[0])]
            size = np.array([len(x) for x in sets])
            shared = np.array([(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum() for x in sets])
            near = node[2000 * shared >= (1000 + t) * (size + len(own) - shared)]
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.full(len(near), pivot))],
                                             names=["node", "pivot"])

    return run


def verify_rows(threshold: float):
    """Arrow function over rows sorted by (bucket, i, j): verify the pairs of block i
    with block j of a bucket that are not in one ball; returns (node, links, root)."""
    t = in_thousandths(threshold)

    def roots_of(linked: np.ndarray) -> np.ndarray:
        """The least member of each one's component in the boolean matrix."""
        label = np.arange(len(linked))
        while True:
            near = np.where(linked, label[None, :], len(linked)).min(1)
            nxt = np.minimum(label, near)
            nxt = nxt[nxt]
            if (nxt == label).all():
                return label
            label = nxt

    def run(batches):
        for g in groups(batches, ["bucket", "i", "j"]):
            bucket, i, j = (g.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            g = g.combine_chunks()
            node, block = g.column("node").to_numpy(), g.column("block").to_numpy()
            copies, size = g.column("copies").to_numpy(), g.column("n_grams").to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in g.column("grams").to_pylist()]
            shared = shared_counts(sets)
            linked = 1000 * shared >= t * (size[:, None] + size[None, :] - shared)
            np.fill_diagonal(linked, False)
            ball = g.column("ball").to_numpy()
            linked &= (ball[:, None] != ball[None, :]) | (ball == NO_BALL)[:, None]
            if i != j:
                linked &= block[:, None] != block[None, :]
            if linked.any():
                # a pair counts in the least bucket that both sides are in
                before = [np.array([b for b in x if b < bucket], np.int64).view(np.uint64)
                          for x in g.column("buckets").to_pylist()]
                linked &= shared_counts(before) == 0
            links = (linked * copies[None, :]).sum(1)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(links[some], pa.int64()), pa.array(node[roots_of(linked)[some]])],
                    names=["node", "links", "root"])

    return run


def cuts_of(rows: Column, n_grams: Column, block_rows: int, block_grams: int) -> Column:
    """Blocks for so many rows and n-grams."""
    return F.greatest(F.ceil(rows / block_rows), F.ceil(n_grams / block_grams)).cast("int")


def balls_of(inside: DataFrame, classes: DataFrame, sets_of, threshold: float, block_rows: int, block_grams: int,
             rows: int) -> DataFrame:
    """(node, ball) for the members of buckets of more than a block (``inside``) that are
    near their pivot: of their buckets' pivots the one in most of them, then the least.
    A set is sent once; a pivot meets its members in chunks of bounded rows and
    n-grams, so one with very many of them is many tasks."""
    parts = shuffle_partitions(inside.sparkSession)
    chosen = written(inside.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("node").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
                     .join(classes.select("node", "h1", "h2", "n_grams", F.col("first.doc_id").alias("first_id")), "node"),
                     "join-pivots", rows=rows)
    chunks = written(chosen.groupBy("pivot").agg(cuts_of(F.count(F.lit(1)), F.sum("n_grams"), block_rows, block_grams)
                                                 .alias("chunks")), "join-chunks", rows=rows)
    own = chunks.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                        F.col("pivot").alias("node"))
    members = written(chosen.where("node <> pivot").join(bounded(chunks), "pivot")
                      .select("pivot", F.pmod(F.xxhash64("node", "pivot"), F.col("chunks")).cast("int").alias("chunk"), "node")
                      .unionByName(own), "join-near", rows=2 * rows)
    found = (sets_of(chosen).join(bounded(members), "node").select("pivot", "chunk", "node", "grams")
             .repartition(parts, "pivot", "chunk").sortWithinPartitions("pivot", "chunk")
             .mapInArrow(near_rows(threshold), "node long, pivot long"))
    out = written(found.groupBy("node").agg(F.min("pivot").alias("ball")), "join-balls", rows=rows)
    discard(chosen, chunks, members)
    return out


def laid_out(inside: DataFrame, balls: DataFrame, block_rows: int, block_grams: int) -> DataFrame:
    """(bucket, node, block, others) for the members of buckets of more than a block:
    the block of each one and the blocks that it meets.  A ball with more than a block of
    members in a bucket has blocks of its own there, which do not meet each other; the other
    members of the bucket share blocks that meet all."""
    none = F.lit(NO_BALL).cast("long")
    member = (inside.select("bucket", "node", "n_grams").join(bounded(balls), "node", "left")
              .withColumn("ball", F.coalesce("ball", none)))
    size = (member.groupBy("bucket", "ball").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"))
            .withColumn("own", (F.col("ball") != none) & (cuts_of(F.col("m"), F.col("grams"), block_rows, block_grams) > 1)))
    bucket = W.partitionBy("bucket")
    before = bucket.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    layout = written(size.groupBy("bucket", F.when(F.col("own"), F.col("ball")).otherwise(none).alias("part"))
                     .agg(cuts_of(F.sum("m"), F.sum("grams"), block_rows, block_grams).alias("cuts"))
                     .withColumns({"first": F.coalesce(F.sum("cuts").over(before), F.lit(0)).cast("int"),
                                   "total": F.sum("cuts").over(bucket).cast("int")}), "join-layout")
    own = layout.where(F.col("part") != none).select("bucket", F.col("part").alias("ball"), F.lit(True).alias("own"))
    last = F.col("first") + F.col("cuts")
    return (member.join(bounded(own), ["bucket", "ball"], "left")
            .withColumn("part", F.when(F.col("own"), F.col("ball")).otherwise(none))
            .join(bounded(layout), ["bucket", "part"])
            .select("bucket", "node",
                    (F.col("first") + F.pmod(F.xxhash64("node", "bucket"), F.col("cuts")).cast("int")).alias("block"),
                    F.filter(F.sequence(F.lit(0), F.col("total") - 1),
                             lambda x: (F.col("part") == none) | (x < F.col("first")) | (x >= last)).alias("others")))


def ball_links(balls: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """(node, links, root) of the pairs within balls; the root is the ball's pivot."""
    known = balls.join(classes.select("node", "copies"), "node")
    whole = written(known.groupBy("ball").agg(F.sum("copies").alias("whole")), "join-ball-sizes", rows=rows)
    return (known.join(bounded(whole), "ball").where("whole > copies")
            .select("node", (F.col("whole") - F.col("copies")).alias("links"), F.col("ball").alias("root")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                 threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
                 block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS,
                 max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least id of the texts joined to
    it by links, its own included), n_links (other rows whose n-gram set has a
    Jaccard similarity of at least ``threshold`` with its own), n_grams, kept (one
    row of each class, one with the least id) and fp (xxhash64 of the text).

    * Null texts and texts without a word have no n-gram and no link: class_id is
      their own id, n_links 0.
    * Texts with equal sets are linked, whatever their order of words.
    * Repeated rows and rows with repeated ids are rows of their own.  Null ids come
      last when the least id is taken.
    * Other columns are ignored.  An empty table gives no row."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bands, rows = choose_bands(threshold, recall, max_hashes)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sig = written(source.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
                  .mapInArrow(signature_rows(n, bands, rows),
                              "doc_id long, fp long, h1 long, h2 long, n_grams long, bands array<long>")
                  .withColumn("uid", F.monotonically_increasing_id()), "join-signatures")

    # classes of equal sets
    n_rows = sig.count()
    key = ["h1", "h2", "n_grams"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
    classes = written(sig.where("n_grams > 0").groupBy(*key)
                      .agg(F.min("uid").alias("node"), first, F.count(F.lit(1)).alias("copies")), "join-classes", rows=n_rows)
    reps = sig.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")

    # buckets of at least two classes; equal member sets are one bucket
    member = written(reps.select(F.col("uid").alias("node"), "n_grams", F.posexplode("bands").alias("band", "hash"))
                     .select("node", "n_grams", F.xxhash64("band", "hash").alias("bucket")), "join-members",
                     rows=n_rows * bands)
    size = member.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"), F.min("node").alias("pivot"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"))
    distinct = size.where("m > 1").groupBy("m", "grams", "pivot", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    cuts = cuts_of(F.col("m"), F.col("grams"), block_rows, block_grams)
    buckets = written(distinct.select("bucket", "m", "pivot", cuts.alias("cuts")), "join-buckets", rows=n_rows * bands)
    n_inside = buckets.agg(F.sum("m")).first()[0] or 0
    inside = written(member.join(bounded(buckets.drop("m")), "bucket"), "join-inside", rows=n_inside)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, grams) of the classes in a written table, computed again from a text of
        theirs; some rows repeat where ids do."""
        texts = source.join(bounded(nodes.select("first_id").distinct(), nodes),
                            F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        return (texts.mapInArrow(gram_rows(n), "doc_id long, h1 long, h2 long, grams binary")
                .join(bounded(nodes.select("node", "h1", "h2"), nodes), ["h1", "h2"]).select("node", "grams"))

    # balls of large buckets; the blocks of each bucket
    none = F.lit(NO_BALL).cast("long")
    blocks = inside.where("cuts = 1").select("bucket", "node", F.lit(0).alias("block"), F.array(F.lit(0)).alias("others"))
    large = inside.where("cuts > 1")
    balls = None
    if not large.isEmpty():
        balls = balls_of(large, classes, sets_of, threshold, block_rows, block_grams, rows=n_rows)
        blocks = blocks.unionByName(laid_out(large, balls, block_rows, block_grams))
    blocks = written(blocks.where(F.size("others") > 0), "join-blocks", rows=n_inside)

    # the classes that meet others there, and their sets
    of_node = (inside.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
               .join(blocks.select("node").distinct(), "node", "left_semi")
               .join(classes.select("node", "h1", "h2", "n_grams", "copies", F.col("first.doc_id").alias("first_id")), "node"))
    of_node = of_node.withColumn("ball", none) if balls is None else (
        of_node.join(bounded(balls), "node", "left").withColumn("ball", F.coalesce("ball", none)))
    wanted = written(of_node, "join-wanted", rows=n_rows)
    sets = sets_of(wanted).groupBy("node").agg(F.first("grams").alias("grams"))
    side = wanted.select("node", "buckets", "n_grams", "copies", "ball")

    # block pairs, verified
    i, j = F.least("block", "other"), F.greatest("block", "other")
    pairs = (blocks.withColumn("other", F.explode("others")).join(side.join(sets, "node"), "node")
             .select("bucket", i.alias("i"), j.alias("j"), "node", "block", "buckets", "n_grams", "copies", "ball", "grams"))
    # a few rounds of tasks for the cores there are: no more files than that helps
    tasks = min(parts, 8 * spark.sparkContext.defaultParallelism)
    verified = written(pairs.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                       .mapInArrow(verify_rows(threshold), "node long, links long, root long").coalesce(tasks),
                       "join-verified")

    if balls is not None:
        links = written(ball_links(balls, classes, n_rows), "join-ball-links", rows=n_rows)
        verified = verified.unionByName(links)
        discard(balls)
    discard(member, buckets, inside, blocks, wanted)

    # classes of linked texts
    linked_rows = verified.count()
    roots = components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")),
                       rows=linked_rows)
    known = classes.select("node", "first", "copies")
    least = written(roots.join(known, "node").groupBy("root").agg(F.min("first").alias("of_class")), "join-least",
                    rows=linked_rows)
    linked = roots.join(bounded(least), "root").select("node", "of_class")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    info = (classes.join(links, "node", "left").join(linked, "node", "left")
            .select(*key, F.coalesce("of_class", "first").alias("of_class"),
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    found = sig.where("n_grams > 0").join(info, key).select(
        "doc_id", F.col("of_class.doc_id").alias("class_id"), "n_links", "n_grams",
        (F.col("uid") == F.col("of_class.uid")).alias("kept"), "fp")
    none = sig.where("n_grams = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams",
        F.lit(True).alias("kept"), "fp")
    return found.unionByName(none)


def bounded(side: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``side`` for a broadcast if its rows (those of ``counted``, a written table)
    are few enough; else as it is, for a shuffle."""
    return F.broadcast(side) if (side if counted is None else counted).count() <= BROADCAST_IDS else side


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one text of each class does."""
    return keep_decided(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
                        jaccard_join(docs).select("doc_id", "fp", "kept"))
