"""Exact top-k by inner product over a forest of M-trees.

Inner product becomes a metric by one more coordinate: with M2 the largest squared
norm, a candidate x is (x, sqrt(M2 - |x|^2)) and a query q is (q, 0); then
d(q, x)^2 = |q|^2 + M2 - 2 q.x, so the nearest are the largest products.  Vectors of
different lengths have no product; each length has trees of its own.

Index: equal vectors are one entry with its least ids.  Entries go to the nearest of
a bounded sample of pivots; a pivot's entries are cut into subtrees of bounded size,
each a bulk-loaded M-tree, stored as pages: a page has a routing object, a covering
radius, its distance to the parent's routing object, and its entries with their
distances to its routing object.  Every row is indexed.

Search: a query first searches the subtree nearest to it; the k-th score found bounds
all others, and a subtree whose ball lies beyond the bound is not visited.  A task
holds one subtree and a block of the queries routed to it, and searches for all of
them at once: down the tree, the distances to a page's children are one matrix
product over the queries that reach the page, less those that the stored parent
distance excludes (triangle inequality); then every query opens its own best leaf,
and after that, with the bounds that these gave, the leaves that are still in reach.
Within a leaf entries are excluded by their distance to its routing object.

Subtrees and queries meet by (subtree, slice): a subtree is copied only for the blocks
of queries that were routed to it.  Scores are integer products below 2^53, so exact
in doubles; bounds allow for rounding, so results are exact.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, shuffle_partitions, written

SCALE = 64
K = 20
PAGE = 256                  # entries of a page
SUBTREE = 4096              # entries of a subtree, while there are few subtrees
MAX_SUBTREES = 16_384       # routing table: so many vectors; subtrees grow instead
MAX_PIVOTS = 1024
PIVOT_LENGTHS = 16          # the commonest lengths have pivots, others are cut by hash
SLICE_QUERIES = 4096        # queries of a block
SLACK = 1e-9                # of the scale of squared distances, for rounding
EXACT = 2.0 ** 53


def least_ids(ids: list[int], k: int) -> list[int]:
    """Of sorted ids the shortest start that holds, whichever id is left out, the k least
    others (as far as there are so many).  An id that occurs often is kept k times."""
    out: list[int] = []
    times: dict[int, int] = {}
    most = 0
    for i in ids:
        n = times.get(i, 0)
        if n >= k:
            continue
        out.append(i)
        times[i] = n + 1
        most = max(most, n + 1)
        if len(out) - most >= k:
            break
    return out


def integer_rows(k: int):
    """Arrow function: (vec_id, embedding) -> (vec, ids): the distinct integer vectors of a
    partition as bytes, with their ``least_ids``."""

    def run(batches):
        found: dict[bytes, list] = {}
        for batch in batches:
            for i, vec in integers(batch):
                have = found.setdefault(vec, [])
                have.append(i)
                if len(have) > 16 * k:
                    have[:] = least_ids(sorted(have), k)
            if len(found) >= 200_000:
                yield _entries(found, k)
                found = {}
        if found:
            yield _entries(found, k)

    return run


def _entries(found, k):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.binary()), pa.array([least_ids(sorted(v), k) for v in found.values()], pa.list_(pa.int64()))],
        names=["vec", "ids"])


def integers(batch: pa.RecordBatch):
    """(id, bytes of floor(64 x)) of the rows that take part."""
    ids, col = batch.column(0).to_pylist(), batch.column(1)
    for i, one in zip(ids, col):
        if i is None or not one.is_valid or not len(one.values):
            continue
        x = one.values
        if x.null_count:
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            yield i, np.floor(SCALE * x).astype("<i8").tobytes()


def by_length(vectors: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length in bytes, places, matrix) of the vectors of each length."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    out = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out.append((d, at, as_matrix([vectors[i] for i in at])))
    return out


def as_matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), -1).astype(np.float64)


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    """The last coordinate of candidates."""
    return np.sqrt(np.maximum(m2 - (x * x).sum(1), 0.0))


def apart(x: np.ndarray, ax: np.ndarray, y: np.ndarray, ay: float) -> np.ndarray:
    """Distances of candidates x to one candidate y."""
    d = x - y
    return np.sqrt((d * d).sum(1) + (ax - ay) ** 2)


def bulk_load(x: np.ndarray, a: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of an M-tree over the candidates (x, a); page 0 is the root.  A page:
    parent, leaf, center (an index into x), radius, parent_distance, members (indexes
    into x, or into the pages) and member_distance (to the center)."""
    pages: list[dict] = []

    def build(members: np.ndarray, center: int, parent: int, parent_distance: float) -> int:
        at = len(pages)
        dist = apart(x[members], a[members], x[center], a[center])
        node = {"parent": parent, "leaf": len(members) <= page, "center": center, "radius": float(dist.max()),
                "parent_distance": parent_distance, "members": members, "member_distance": dist}
        pages.append(node)
        if node["leaf"]:
            return at
        ways = min(page, -(-len(members) // (page // 2)))
        chosen = members[np.linspace(0, len(members) - 1, ways).astype(int)]
        to = np.stack([apart(x[members], a[members], x[c], a[c]) for c in chosen])
        nearest = to.argmin(0)
        parts = [(int(c), members[nearest == i]) for i, c in enumerate(chosen)]
        parts = [(c, m) for c, m in parts if len(m)]
        if max(len(m) for _, m in parts) > 0.9 * len(members):      # no structure here: cut evenly
            parts = [(int(m[0]), m) for m in np.array_split(members, ways)]
        children, away = [], []
        for c, m in parts:
            away.append(float(apart(x[[c]], a[[c]], x[center], a[center])[0]))
            children.append(build(m, c, at, away[-1]))
        node["members"], node["member_distance"] = np.array(children), np.array(away)
        return at

    everything = np.arange(len(x))
    build(everything, 0, -1, 0.0)
    return pages


class Subtree:
    """One M-tree, loaded from its pages, with its search for a block of queries."""

    def __init__(self, pages: list[dict], m2: float):
        self.m2 = m2
        self.pages = {p["page"]: p for p in pages}
        only, self.ids, n = [], [], 0
        for p in pages:
            p["center"] = np.frombuffer(p["center"], "<i8").astype(np.float64)
            p["member_distance"] = np.frombuffer(p["member_distance"], "<f8")
            if p["leaf"]:
                p["x"] = np.frombuffer(p["members"], "<i8").reshape(len(p["ids"]), -1).astype(np.float64)
                p["entry"] = np.arange(n, n + len(p["ids"]))
                n += len(p["ids"])
                self.ids += p["ids"]
            else:
                p["children"] = np.frombuffer(p["members"], "<i8")
        for p in pages:
            if not p["leaf"]:
                below = [self.pages[c] for c in p["children"].tolist()]
                p["x"] = np.stack([c["center"] for c in below])
                p["radii"] = np.array([c["radius"] for c in below])
        # the id of an entry that has no other, and which entries have one row
        self.single = np.array([i[0] == i[-1] for i in self.ids])
        self.alone = np.array([len(i) == 1 for i in self.ids])
        self.first = np.array([i[0] for i in self.ids], np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """For each query (row of ``q``) the at most k best rows of other ids than ``own``
        with a score of at least ``floor``, by (-score, id): flat arrays of query, loss and
        id, and the number of distances computed for each query."""
        n = len(q)
        base = (q * q).sum(1) + self.m2
        slack = SLACK * np.maximum(base, 1.0)
        floor = floor.copy()
        top = np.full((n, k), -np.inf)
        computed = np.ones(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def reach(rows: np.ndarray) -> np.ndarray:
            """Distance beyond which no score reaches the floor."""
            known = np.where(np.isinf(floor[rows]), 0.0, floor[rows])
            far = np.sqrt(np.maximum(base[rows] - 2 * known, 0.0) + slack[rows]) + np.sqrt(slack[rows]) * 1e-3
            return np.where(np.isinf(floor[rows]), np.inf, far)

        def distances(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(base[rows][:, None] - 2 * (q[rows] @ x.T), 0.0))

        root = self.pages[0]
        everyone = np.arange(n)
        todo, leaves = [(root, everyone, distances(everyone, root["center"][None, :])[:, 0])], []
        while todo:
            page, rows, d = todo.pop()
            if page["leaf"]:
                leaves.append((page, rows, d))
                continue
            far = reach(rows)[:, None]
            chance = np.abs(d[:, None] - page["member_distance"]) - page["radii"] <= far
            rows, d, far, chance = (v[chance.any(1)] for v in (rows, d, far, chance))
            if not len(rows):
                continue
            computed[rows] += chance.sum(1)
            to = distances(rows, page["x"])
            chance &= to - page["radii"] <= far
            for c, child in enumerate(page["children"].tolist()):
                if chance[:, c].any():
                    todo.append((self.pages[child], rows[chance[:, c]], to[chance[:, c], c]))

        def visit(page: dict, rows: np.ndarray, d: np.ndarray) -> None:
            near = np.abs(d[:, None] - page["member_distance"]) <= reach(rows)[:, None]
            columns = np.flatnonzero(near.any(0))
            if not len(columns):
                return
            computed[rows] += near.sum(1)
            entry = page["entry"][columns]
            score = q[rows] @ page["x"][columns].T
            score[self.single[entry] & (self.first[entry] == own[rows][:, None])] = -np.inf
            both = np.concatenate([top[rows], score], axis=1)
            top[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor[rows] = np.maximum(floor[rows], top[rows].min(1))
            r, c = np.nonzero((score >= floor[rows][:, None]) & (score > -np.inf))
            found.append((rows[r], score[r, c], entry[c]))

        best, at = np.full(n, np.inf), np.full(n, -1)
        for i, (page, rows, d) in enumerate(leaves):
            low = np.maximum(d - page["radius"], 0.0)
            better = low < best[rows]
            best[rows[better]], at[rows[better]] = low[better], i
        for i, (page, rows, d) in enumerate(leaves):
            mine = at[rows] == i
            if mine.any():
                visit(page, rows[mine], d[mine])
        order = sorted(range(len(leaves)), key=lambda i: float((leaves[i][2] - leaves[i][0]["radius"]).mean()))
        for i in order:
            page, rows, d = leaves[i]
            left = (at[rows] != i) & (d - page["radius"] <= reach(rows))
            if left.any():
                visit(page, rows[left], d[left])
        return (*self.rows(found, own, k, floor), computed)

    def rows(self, found, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best rows of the entries found."""
        if not found:
            return (np.zeros(0, np.int64),) * 3
        who, score, entry = (np.concatenate([f[i] for f in found]) for i in range(3))
        keep = score >= floor[who]
        who, loss, entry = who[keep], -score[keep].astype(np.int64), entry[keep]
        one = self.alone[entry]
        parts = [(who[one], loss[one], self.first[entry[one]])]
        for w, s, e in zip(who[~one].tolist(), loss[~one].tolist(), entry[~one].tolist()):
            others = np.array([i for i in self.ids[e] if i != own[w]][:k], np.int64)
            parts.append((np.full(len(others), w), np.full(len(others), s), others))
        who, loss, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ids, loss, who))
        who, loss, ids = who[order], loss[order], ids[order]
        start = np.searchsorted(who, who)
        keep = np.arange(len(who)) - start < k
        return who[keep], loss[keep], ids[keep]


PAGES = ("subtree int, page int, parent int, leaf boolean, radius double, parent_distance double, center binary, "
         "members binary, member_distance binary, ids array<array<long>>")
PAGE_SCHEMA = pa.schema([
    ("subtree", pa.int32()), ("page", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()),
    ("radius", pa.float64()), ("parent_distance", pa.float64()), ("center", pa.binary()), ("members", pa.binary()),
    ("member_distance", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
TOP = pa.list_(pa.struct([("loss", pa.int64()), ("id", pa.int64())]))


def page_rows(m2: dict[int, float]):
    """Arrow function: entries sorted by subtree -> the pages of each subtree's M-tree."""
    def run(batches):
        for g in groups(batches, ["subtree"]):
            vectors, ids = g.column("vec").to_pylist(), g.column("ids").to_pylist()
            x = as_matrix(vectors)
            pages = bulk_load(x, lifted(x, m2[len(vectors[0])]))
            rows = []
            for i, p in enumerate(pages):
                leaf = p["leaf"]
                rows.append({
                    "subtree": g.column("subtree")[0].as_py(), "page": i, "parent": p["parent"], "leaf": leaf,
                    "radius": p["radius"], "parent_distance": p["parent_distance"], "center": vectors[p["center"]],
                    "members": b"".join(vectors[m] for m in p["members"]) if leaf else p["members"].astype("<i8").tobytes(),
                    "member_distance": p["member_distance"].astype("<f8").tobytes(),
                    "ids": [ids[m] for m in p["members"]] if leaf else []})
            yield from pa.Table.from_pylist(rows, schema=PAGE_SCHEMA).to_batches()

    return run


def search_rows(k: int, m2: dict[int, float]):
    """Arrow function over rows sorted by (subtree, slice, kind): the pages of a subtree,
    then queries (number in ``page``, own id in ``own``, floor in ``radius``); returns
    (qn, own, vec, top, computed, floor), with the score that other rows need to count."""
    def run(batches):
        for g in groups(batches, ["subtree", "slice"]):
            kind = g.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut == len(kind):
                continue
            queries = g.slice(cut)
            vecs = queries.column("center").to_pylist()
            q = as_matrix(vecs)
            tree = Subtree(g.slice(0, cut).to_pylist(), m2[len(vecs[0])])
            who, loss, ids, computed = tree.search(q, queries.column("own").to_numpy(), k, queries.column("radius").to_numpy())
            counts = np.bincount(who, minlength=len(q))
            ends = np.cumsum(counts)
            floor = np.full(len(q), -np.inf)
            full = counts == k
            floor[full] = -loss[ends[full] - 1].astype(np.float64)
            hits = pa.StructArray.from_arrays([pa.array(loss), pa.array(ids)], names=["loss", "id"])
            yield pa.RecordBatch.from_arrays(
                [queries.column("qn").combine_chunks(), queries.column("own").combine_chunks(), pa.array(vecs, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), hits).cast(TOP), pa.array(computed),
                 pa.array(floor)], names=["qn", "own", "vec", "top", "computed", "floor"])

    return run


def searched(pages: DataFrame, queries: DataFrame, k: int, m2: dict[int, float]) -> DataFrame:
    """``queries`` (written): subtree, qn, own, vec, floor.  A subtree goes to as many tasks
    as it has blocks of queries."""
    parts = shuffle_partitions(pages.sparkSession)
    cuts = F.broadcast(queries.groupBy("subtree").agg(F.ceil(F.count(F.lit(1)) / SLICE_QUERIES).cast("int").alias("cuts")))
    asked = queries.join(cuts, "subtree").select(
        "subtree", F.pmod(F.xxhash64("qn"), F.col("cuts")).cast("int").alias("slice"), F.lit(1).alias("kind"),
        "qn", "own", F.col("vec").alias("center"), F.col("floor").alias("radius"))
    stored = (pages.join(cuts, "subtree").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
              .withColumn("kind", F.lit(0)).drop("cuts"))
    return (stored.unionByName(asked, allowMissingColumns=True).repartition(parts, "subtree", "slice")
            .sortWithinPartitions("subtree", "slice", "kind")
            .mapInArrow(search_rows(k, m2), "qn long, own long, vec binary, top array<struct<loss:long,id:long>>, "
                        "computed long, floor double"))


def top_k(vectors: DataFrame, is_query=None, k: int = K, subtree: int = SUBTREE, with_work: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k other rows of
    the largest integer products, ties to the smaller vec_id.  ``with_work``: also
    computed and candidates, the distances computed for the query and the entries of
    its length.

    ``is_query`` is a condition on vec_id (default: divisible by 20).  Vectors that
    are null or empty, or hold a null or a non-finite component, and rows with a null
    vec_id take no part.  Vectors have a product with those of their own length only.
    Every row is a candidate of its own, also one that repeats a vec_id or a whole row;
    none of the query's own id is found for it.  A vec_id with several vectors asks
    once for each of them.  A squared length of 2^53 or more raises (products would not
    be exact).  Other columns are ignored; no vector, no row."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    is_query = (lambda i: i % 20 == 0) if is_query is None else is_query
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))

    def with_id(batches):
        for batch in batches:
            rows = list(integers(batch))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["own", "vec"])

    entries = written(source.mapInArrow(integer_rows(k), "vec binary, ids array<long>").groupBy("vec")
                      .agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")), "mtree-entries")
    asked = written(source.where(is_query(F.col("vec_id"))).mapInArrow(with_id, "own long, vec binary").distinct()
                    .withColumn("qn", F.monotonically_increasing_id()), "mtree-queries")

    def norm_rows(batches):
        for batch in batches:
            for d, at, x in by_length(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([float((x * x).sum(1).max())]), pa.array([len(at)])],
                                                 names=["d", "m2", "n"])

    lengths = {r["d"]: r for r in entries.select("vec").mapInArrow(norm_rows, "d long, m2 double, n long").groupBy("d")
               .agg(F.max("m2").alias("m2"), F.sum("n").alias("n")).collect()}
    if not lengths:
        work = ", computed long, candidates long" if with_work else ""
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + work)
    m2 = {d: r["m2"] for d, r in lengths.items()}
    if max(m2.values()) >= EXACT:
        raise ValueError("vectors of a squared length of 2^53 or more (of 64 times their components) have no exact products here")
    count = sum(r["n"] for r in lengths.values())
    size = max(subtree, -(-2 * count // MAX_SUBTREES))

    # numbers of the pivots of each length, from its first one on
    pivots: dict[int, list[bytes]] = {}
    first_pivot, n_pivots = {}, 0
    for d in sorted(lengths, key=lambda d: (-lengths[d]["n"], d)):
        wanted = min(MAX_PIVOTS, lengths[d]["n"] // size)
        pivots[d] = [r["vec"] for r in entries.where(F.octet_length("vec") == d).select("vec")
                     .orderBy(F.xxhash64("vec"), "vec").limit(wanted).collect()] if wanted > 1 and len(pivots) < PIVOT_LENGTHS else []
        first_pivot[d] = n_pivots
        n_pivots += max(1, len(pivots[d]))

    def assign(batches):
        at_hand = {d: as_matrix(p) for d, p in pivots.items() if p}
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int32)
            for d, at, x in by_length(batch.column(0).to_pylist()):
                near[at] = first_pivot[d]
                if d in at_hand:
                    p = at_hand[d]
                    near[at] += (x @ p.T + lifted(x, m2[d])[:, None] * lifted(p, m2[d])[None, :]).argmax(1).astype(np.int32)
            ids = pa.array([least_ids(i, k) for i in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(near)], names=["vec", "ids", "pivot"])

    assigned = written(entries.mapInArrow(assign, "vec binary, ids array<long>, pivot int"), "mtree-assigned")
    held = {r["pivot"]: r["n"] for r in assigned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [max(1, -(-held.get(p, 0) // size)) for p in range(n_pivots)]
    starts = [sum(cuts[:p]) for p in range(n_pivots)] if n_pivots < 10_000 else np.r_[0, np.cumsum(cuts)[:-1]].tolist()

    def of_pivot(values: list[int]):
        return F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), F.col("pivot"))

    subtree_of = (of_pivot(starts) + F.pmod(F.xxhash64("vec"), of_pivot(cuts))).cast("int")
    pages = written(assigned.select("vec", "ids", subtree_of.alias("subtree"))
                    .repartition(parts, "subtree").sortWithinPartitions("subtree", "vec")
                    .mapInArrow(page_rows(m2), PAGES), "mtree-pages")
    discard(entries, assigned)

    # routing table: the roots of the subtrees
    roots = pages.where("page = 0").select("subtree", "center", "radius").orderBy("subtree").collect()

    def route(home: bool):
        def run(batches):
            of = {d: (at, x) for d, at, x in by_length([bytes(r["center"]) for r in roots])}
            radii = np.array([r["radius"] for r in roots])
            number = np.array([r["subtree"] for r in roots], np.int32)
            for batch in batches:
                vecs = batch.column(2).to_pylist()
                floors = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                for d, at, q in by_length(vecs):
                    there, centers = of[d]
                    base = (q * q).sum(1) + m2[d]
                    away = np.sqrt(np.maximum(base[:, None] - 2 * q @ centers.T, 0.0))
                    nearest = away.argmin(1)
                    floor = floors[at]
                    if home:
                        who, where = np.arange(len(q)), nearest
                    else:
                        slack = SLACK * np.maximum(base, 1.0)
                        reach = np.sqrt(np.maximum(base - 2 * np.where(np.isinf(floor), 0, floor), 0) + slack) + np.sqrt(slack) * 1e-3
                        reach[np.isinf(floor)] = np.inf
                        visit = away - radii[there][None, :] <= reach[:, None]
                        visit[np.arange(len(q)), nearest] = False
                        who, where = np.nonzero(visit)
                    rows = pa.array(at[who])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[there[where]]), batch.column(0).take(rows), batch.column(1).take(rows),
                         batch.column(2).take(rows), pa.array(floor[who])], names=["subtree", "qn", "own", "vec", "floor"])
        return run

    schema = "subtree int, qn long, own long, vec binary, floor double"
    start = asked.select("qn", "own", "vec", F.lit(float("-inf")).alias("floor"))
    near = written(searched(pages, written(start.mapInArrow(route(True), schema), "mtree-home"), k, m2), "mtree-near")
    others = written(near.select("qn", "own", "vec", "floor").mapInArrow(route(False), schema), "mtree-far")
    found = near.drop("floor").unionByName(searched(pages, others, k, m2).drop("floor"))
    work = ([F.sum("computed").alias("computed"), F.first(F.octet_length("vec")).alias("d")] if with_work else [])
    top = found.groupBy("qn", "own").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"), *work)
    out = top.select(F.col("own").alias("query_id"), F.posexplode("top").alias("place", "t"), *(["computed", "d"] if with_work else []))
    sizes = F.create_map(*[F.lit(v) for d, r in lengths.items() for v in (int(d), int(r["n"]))]) if with_work else None
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"),
                      (-F.col("t.loss")).alias("score"),
                      *(["computed", sizes[F.col("d")].cast("long").alias("candidates")] if with_work else []))
