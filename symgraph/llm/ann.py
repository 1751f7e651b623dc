"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is grown from the top on a bounded sample: each node with more vectors than a leaf is to hold is split by k-means. Its
nodes are no more than the sample, so the driver and the tasks can hold it, whatever the number of rows. All rows then go to
their leaf. A query goes down by a priority queue of the nodes not yet opened, nearest centroid first, works out the distances of a node's
children when it opens it, and visits leaves in that order. How many is calibrated: for a sample of queries the exact
neighbours are found over all rows, and visits are widened until the wanted recall of them is reached.

Leaves that are neighbours in the tree make a shard of about SHARD_ROWS rows. A leaf with more rows, such as one of equal vectors, is
spread over several shards, and queries of a shard come in blocks, so no task holds more than a block of either.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BRANCH, LEAF_ROWS, ROUNDS = 16, 256, 8
#: numbers (rows x dimensions) of the sample that the tree is fitted on at most, and the least rows of it in a leaf
SAMPLE_NUMBERS, SAMPLE_LEAF = 12_800_000, 16
#: queries that the number of visits is calibrated on
CALIBRATE = 200
#: elements from here on would overflow a squared distance in single precision
LARGEST = 1e15
#: rows of a shard, queries of a block, and distances that are worked out at once
SHARD_ROWS, BLOCK_QUERIES, CELLS = 32_768, 16_384, 1 << 21


@dataclass
class Tree:
    """children: of each inner node, in the order of their numbers; leaves are the nodes without any."""

    centroids: np.ndarray
    children: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.squares = (self.centroids**2).sum(1)
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            kids = self.children.get(node)
            if kids is None:
                order.append(node)
            else:
                todo += kids[::-1].tolist()
        #: all leaves, neighbours in the tree side by side, and the number of each in this order
        self.leaves = np.array(order)
        self.rank = np.full(len(self.centroids), -1)
        self.rank[self.leaves] = np.arange(len(order))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The rank of each row's leaf: at each node the nearest child (of equal ones the first)."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children.get(node)
            if kids is None:
                out[rows] = self.rank[node]
                continue
            nearest = (self.squares[kids][None] - 2 * x[rows] @ self.centroids[kids].T).argmin(1)
            order = np.argsort(nearest, kind="stable")
            at = np.searchsorted(nearest[order], np.arange(len(kids) + 1))
            todo += [(int(kids[j]), rows[order[at[j] : at[j + 1]]]) for j in range(len(kids)) if at[j] < at[j + 1]]
        return out

    def visits(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves (ranks) of a query in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            kids = self.children.get(node)
            if kids is None:
                out.append(int(self.rank[node]))
            else:
                for d, k in zip((self.squares[kids] - 2 * self.centroids[kids] @ q).tolist(), kids.tolist()):
                    heapq.heappush(queue, (d, k))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def _split(x: np.ndarray, m: int, r: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """k-means by Lloyd's rounds: centroids that have rows, and the one of each row."""
    c = x[r.choice(len(x), m, replace=False)]
    for _ in range(rounds + 1):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(used)))
        c = (np.add.reduceat(x[order].astype(np.float64), at, axis=0) / np.bincount(near)[:, None]).astype(np.float32)
    return c, near


def grow(x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 0) -> Tree:
    """A tree whose leaves hold at most `leaf` rows of x, but for equal rows, which are never parted."""
    r = np.random.default_rng(seed)
    centroids, children, todo = [x.mean(0)], {}, [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf or (x[rows] == x[rows[0]]).all():
            continue
        c, near = _split(x[rows], min(len(rows), branch, max(2, -(-len(rows) // leaf))), r)
        if len(c) < 2:  # the chosen rows were equal: part by the distance from them
            far = ((x[rows] - x[rows[0]]) ** 2).sum(1)
            near = (far > far.mean()).astype(np.int64)
            c = np.stack([x[rows[near == j]].mean(0) for j in (0, 1)])
        children[node] = np.arange(len(centroids), len(centroids) + len(c))
        centroids += list(c)
        todo += [(int(k), rows[near == j]) for j, k in enumerate(children[node])]
    return Tree(np.array(centroids, np.float32), children)


def _sample(vectors: DataFrame, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of at most `most` of n rows, those of the least hashes of their ids."""
    if n > 2 * most:  # about as many as are wanted, chosen by a bound on the hash, so that no task sorts all its rows
        vectors = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((1 << 40) * 1.2 * most / n))
    rows = vectors.select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("h")).toArrow()
    order = np.lexsort((rows.column("vec_id").to_numpy(), rows.column("h").to_numpy()))[:most]
    return rows.column("vec_id").to_numpy()[order], _matrix(rows.column("x"))[order]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)


def closest(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of queries: query, row, squared distance of each one's k nearest rows but itself, with all ties for the last place. ids are sorted."""
    step = max(1, CELLS // max(1, len(x)))
    for lo in range(0, len(q), step):
        d = _distances(q[lo : lo + step], x)
        place = np.minimum(np.searchsorted(ids, own[lo : lo + step]), len(ids) - 1)
        me = np.flatnonzero(ids[place] == own[lo : lo + step])
        d[me, place[me]] = np.inf
        m = min(k, len(ids))
        last = np.partition(d, m - 1, axis=1)[:, m - 1]
        # single precision finds them, double decides
        a, b = np.nonzero((d <= (last * (1 + 1e-5) + 1e-6)[:, None]) & np.isfinite(d))
        yield a + lo, b, ((q[a + lo].astype(np.float64) - x[b]) ** 2).sum(1)


def best_of(query: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k nearest, by query, distance and id."""
    order = np.lexsort((ids, d, query))
    first = np.flatnonzero(np.append(True, np.diff(query[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < k]


def calibrate(vectors: DataFrame, tree: Tree, q: np.ndarray, own: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves whose first visits hold the wanted share of the exact neighbours of the queries q."""
    if len(tree.leaves) < 2 or not len(q):
        return 1
    model = vectors.sparkSession.sparkContext.broadcast((tree, q, own))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, q, own = model.value
        have: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(batch.schema.get_field_index("x"))), batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for a, b, d in closest(q, own, x, ids, k):
                have.append((a, ids[b], d, known.descend(x[b])))
            joined = [np.concatenate(c) for c in zip(*have)]
            keep = best_of(*joined[:3], k)
            have = [tuple(c[keep] for c in joined)]
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in have[0]], ["q", "vec_id", "d", "leaf"])

    near = vectors.mapInArrow(nearest, "q long, vec_id long, d double, leaf long")
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("i") <= k).select("q", "leaf").collect()  # k for each of few queries
    model.unpersist()
    at = [np.argsort(tree.visits(v, len(tree.leaves)), kind="stable") for v in q]
    need = np.sort([at[r.q][r.leaf] + 1 for r in near])
    return int(need[max(0, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 1


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a shard's queries and rows: for each query its k nearest rows in the leaves that it visits."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            ids, leaf = (rows.column(c).to_numpy() for c in ("vec_id", "leaf"))
            order = np.lexsort((ids, leaf))
            ids, leaf, x = ids[order], leaf[order], _matrix(rows.column("x"))[order]
            own, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("x"))
            visits = queries.column("leaves").combine_chunks()
            visit, query = visits.flatten().to_numpy(), np.repeat(np.arange(len(own)), np.diff(visits.offsets.to_numpy()))
            order = np.argsort(visit, kind="stable")
            visit, query = visit[order], query[order]
            at = np.flatnonzero(np.append(True, np.diff(visit) != 0))
            size = 0
            for lo, hi in zip(at, np.append(at[1:], len(visit))):
                first, last = np.searchsorted(leaf, visit[lo]), np.searchsorted(leaf, visit[lo], side="right")
                if first == last:
                    continue
                mine = query[lo:hi]
                for a, b, d in closest(q[mine], own[mine], x[first:last], ids[first:last], k):
                    found.append((own[mine[a]], ids[first + b], d))
                    size += len(d)
                if size > CELLS:  # keep only the running best
                    found = [_kept(found, k)]
                    size = len(found[0][0])
        out = _kept(found, k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(list(map(pa.array, out)), names=["vec_id", "neighbor_id", "distance"])

    return run


def _kept(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    joined = [np.concatenate(c) for c in zip(*found)]
    keep = best_of(*joined, k)
    return tuple(c[keep] for c in joined)


def shards(counts: np.ndarray, most: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first shard and the number of its shards: neighbours together up to `most` rows, a larger leaf in several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[i] = shard
        held += n
        if n > most:
            parts[i] = -(-n // most)
            shard, held = shard + int(parts[i]), 0
    return first, parts


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, recall: float = 0.95, leaf_rows: int = LEAF_ROWS, query_every: int = 1, vector_col: str = "embedding", id_col: str = "vec_id", sample_numbers: int = SAMPLE_NUMBERS, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1), distance (Euclidean): for every row whose id is divisible by ``query_every`` its k nearest others, approximately.

    ``recall`` is what the number of leaf visits is calibrated to, on 200 of the queries against all rows. The tree is fitted on at most
    ``sample_numbers`` / dimensions rows, those of the least hashes of their ids; all rows are indexed. A leaf holds about ``leaf_rows`` rows,
    and more of a table with over ``leaf_rows`` / 16 times as many rows as the sample. Ties in distance go to the lesser id.

    Rows with a null id, a null or empty vector, a null or non-finite element or one of at least 1e15, or a length other than the commonest (of equally
    common ones the longest) are neither queries nor neighbours. Rows with the same id are one row, the one with the least vector; a row
    isn't its own neighbour, but equal vectors of other ids are. With fewer than k others there are fewer rows. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    if k < 1 or not 0 < recall <= 1 or query_every < 1:
        raise ValueError("k and query_every must be positive, and recall above 0 and at most 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))).groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = written(rows, "vectors")
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return rows.select("vec_id", F.col("vec_id").alias("neighbor_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    rows = rows.where(F.size("x") == common.n)
    is_query = F.col("vec_id") % query_every == 0
    _, x = _sample(rows, max(1, sample_numbers // common.n), common["count"])
    tree = grow(x, max(SAMPLE_LEAF, leaf_rows * len(x) // common["count"]) if len(x) < common["count"] else leaf_rows)
    asking = rows.where(is_query)
    own, q = _sample(asking, CALIBRATE, asking.count())
    visits = calibrate(rows, tree, q, own, k, recall)
    context = rows.sparkSession.sparkContext
    model = context.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.descend(x))], ["vec_id", "x", "leaf"])

    placed = written(rows.select("vec_id", "x").mapInArrow(place, "vec_id long, x array<float>, leaf long"), "placed-vectors")
    counts = np.zeros(len(tree.leaves), np.int64)
    for r in placed.groupBy("leaf").count().collect():  # no more rows than leaves
        counts[r.leaf] = r["count"]
    first, parts = shards(counts, shard_rows)
    where = context.broadcast((first, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each shard with leaves that it visits."""
        first, parts = where.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                query, shard, cut, leaf = [], [], [0], []
                for i, v in enumerate(_matrix(part.column(1))):
                    leaves = np.array(model.value.visits(v, visits))
                    one = np.repeat(leaves, parts[leaves])
                    nth = np.arange(len(one)) - np.repeat(np.cumsum(parts[leaves]) - parts[leaves], parts[leaves])
                    of = first[one] + nth
                    order = np.argsort(of, kind="stable")
                    at = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
                    query.append(np.full(len(at), i))
                    shard.append(of[order][at])
                    leaf.append(one[order])
                    cut += (cut[-1] + np.append(at[1:], len(order))).tolist()
                take = pa.array(np.concatenate(query))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), part.column(0).take(take), part.column(1).take(take), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(leaf)))], ["shard", "vec_id", "x", "leaves"])

    queries = written(rows.where(is_query).select("vec_id", "x").mapInArrow(ask, "shard long, vec_id long, x array<float>, leaves array<long>"), "asked-vectors")
    blocks = queries.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    leaf_table = rows.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, parts))], "leaf long, first long, parts long")
    of_shard = placed.join(F.broadcast(leaf_table), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))  # one row for each leaf
    of_shard = of_shard.join(blocks, "shard").select("vec_id", "x", "leaf", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = queries.join(blocks, "shard").select("vec_id", "x", "leaves", "shard", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
    found = asked.groupBy("shard", "block").cogroup(of_shard.groupBy("shard", "block")).applyInArrow(_search(k), "vec_id long, neighbor_id long, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return ranked.select("vec_id", "neighbor_id", "rank", F.round(F.sqrt("distance"), 6).alias("distance"))
