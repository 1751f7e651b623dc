"""PageRank over counted edges.

Nodes are numbered in order of a 64-bit hash of their ids and lie in blocks by its first bits. The edges are shuffled once, to the block of their
target, which writes them to the shared folder as numbers; a round then reads these files and the last ranks where they lie and writes the new
ranks, without a shuffle.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING, ITERATIONS, TOLERANCE = 0.85, 20, 1e-6
#: nodes of a block, about; edges that a task numbers and writes at once
BLOCK, CHUNK = 1 << 16, 1 << 22


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; where that is unset (tests on one machine), one of our own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all hosts share")
        folder = "file://" + tempfile.mkdtemp(prefix="symgraph-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def mounted(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, by the path at which every host has it mounted; deleted when the session's JVM ends."""
    path, jvm = shared_folder(spark, name), spark.sparkContext._jvm
    local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    if "://" in local:
        raise ValueError(f"{path}: spark.checkpoint.dir has to be on a file system that is mounted on all hosts")
    os.makedirs(local)
    at = jvm.org.apache.hadoop.fs.Path(f"file://{local}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return local


def sized(path: str, n: int) -> str:
    """A file of n zeros of 8 bytes, which tasks fill."""
    with open(path, "wb") as f:
        f.truncate(8 * n)
    return path


def put(path: str, start: int, values: np.ndarray) -> None:
    """A task's own stretch of the file; a repeated task writes the same again."""
    with open(path, "r+b") as f:
        f.seek(8 * start)
        f.write(values.tobytes())


def placed(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the sorted keys, and which of those wanted are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Blocks:
    """The files of a graph: keys (hashes, sorted), out (numbers of edges that begin at a node) and the edges of each block."""

    def __init__(self, ids: DataFrame, n: int):
        self.spark, self.ids, self.n = ids.sparkSession, ids, n
        self.folder = mounted(self.spark, "pagerank")
        self.bits = max(1, (max(1, n // BLOCK) - 1).bit_length())
        self.count = 1 << self.bits
        for self.seed in itertools.count():  # another seed if two ids have one hash
            hashed = ids.select(self.key("id").alias("h")).withColumn("b", self.block("h"))
            sizes = {r["b"]: r.k for r in hashed.groupBy("b").agg(F.count("*").alias("k")).collect()}
            self.starts = [0, *itertools.accumulate(sizes.get(b, 0) for b in range(self.count))]
            path, starts = sized(f"{self.folder}/keys", n), self.starts

            def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b, (h,) in columns(batches, 1):
                    h.sort()
                    put(path, starts[b], h)
                    yield pa.record_batch({"different": np.array([len(np.unique(h))], np.int64)})

            if hashed.repartitionById(self.count, F.col("b")).mapInArrow(write, "different long").agg(F.sum("different")).first()[0] == n:
                break

    def key(self, column: str) -> Column:
        return F.xxhash64(F.col(column), F.lit(self.seed))

    def block(self, column: str) -> Column:
        return (F.shiftright(column, 64 - self.bits) + (self.count >> 1)).cast("int")

    def write(self, edges: DataFrame) -> tuple[dict[int, list[str]], int]:
        """The files of each block's edges, and the number of nodes without edges. One job, so that both read the same shuffles of the edges; ends without an id count for the degree alone."""
        kind, folder, starts, n = self.ids.schema["id"].dataType, self.folder, self.starts, self.n
        end = lambda c: F.when(F.col(c).isNotNull(), self.key(c))
        e = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("n").cast("long").alias("n")).select(end("src").alias("s"), end("dst").alias("d"), "n")
        sized(f"{folder}/out", n)

        def write_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = np.memmap(f"{folder}/keys", np.int64, "r")
            for b, (s, d, k) in columns(batches, 3, CHUNK):
                order = np.argsort(s)
                s, d, k = s[order], d[order], k[order]
                (src, known), (dst, own) = placed(keys, s), placed(keys[starts[b] : starts[b + 1]], d)
                known &= own
                name = f"{folder}/{b}-{uuid.uuid4().hex}"
                for what, x in (("src", src[known].astype(np.min_scalar_type(n))), ("dst", dst[known].astype(np.int32)), ("n", k[known].astype(np.uint8) if len(k) and 0 <= k.min() and k.max() < 256 else k[known])):
                    np.save(f"{name}.{what}.npy", x)
                yield pa.record_batch({"b": np.array([b], np.int32), "file": pa.array([name]), "k": np.array([0], np.int64)})

        def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = np.memmap(f"{folder}/keys", np.int64, "r")
            for b, (s, k) in columns(batches, 2):
                at, known = placed(own := keys[starts[b] : starts[b + 1]], s)
                out = np.zeros(len(own))
                out[at[known]] = k[known]
                put(f"{folder}/out", starts[b], out)
                yield pa.record_batch({"b": np.array([b], np.int32), "file": pa.array([None], pa.string()), "k": np.array([(out > 0).sum()], np.int64)})

        into, by = "b int, file string, k long", F.col("b")
        targets = e.select("s", "d", "n", F.coalesce(self.block("d"), F.lit(0)).alias("b")).repartitionById(self.count, by).mapInArrow(write_edges, into)
        degrees = e.groupBy("s").agg(F.sum("n").alias("n")).select("s", "n", F.coalesce(self.block("s"), F.lit(0)).alias("b")).repartitionById(self.count, by).mapInArrow(write_out, into)
        files: dict[int, list[str]] = {b: [] for b in range(self.count)}
        linked = 0
        for r in targets.union(degrees).collect():  # a row for each file
            linked += r.k
            if r.file:
                files[r["b"]].append(r.file)
        return files, n - linked

    def round(self, files: dict[int, list[str]], old: str | None, new: str, base: float, damping: float) -> tuple[float, float]:
        """Write the new ranks; their change, and the rank of nodes without edges."""
        folder, starts, n = self.folder, self.starts, self.n
        sized(new, n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.memmap(f"{folder}/out", np.float64, "r")
            rank = np.memmap(old, np.float64, "r") if old else np.broadcast_to(1.0 / n, n)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    lo, hi = starts[b], starts[b + 1]
                    got = np.zeros(hi - lo)
                    for f in files[b]:
                        src, dst, k = (np.load(f"{f}.{what}.npy") for what in ("src", "dst", "n"))
                        got += np.bincount(dst, rank[src] / out[src] * k, hi - lo)
                    value = base + damping * got
                    put(new, lo, value)
                    yield pa.record_batch({"b": np.array([b], np.int64), "change": [float(np.abs(value - rank[lo:hi]).sum())], "lost": [float(value[out[lo:hi] == 0].sum())]})

        tasks = min(self.count, 4 * self.spark.sparkContext.defaultParallelism)
        rows = sorted(self.spark.range(0, self.count, 1, tasks).mapInArrow(run, "b long, change double, lost double").collect())
        return sum(r.change for r in rows), sum(r.lost for r in rows)

    def ranks(self, path: str) -> DataFrame:
        """id, score."""
        folder = self.folder

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, rank = np.memmap(f"{folder}/keys", np.int64, "r"), np.memmap(path, np.float64, "r")
            for batch in batches:
                yield pa.record_batch({"id": batch.column(0), "score": rank[np.searchsorted(keys, batch.column(1).to_numpy())]})

        return self.ids.select("id", self.key("id").alias("h")).mapInArrow(look_up, f"id {self.ids.schema['id'].dataType.simpleString()}, score double")


def columns(batches: Iterator[pa.RecordBatch], n: int, most: int | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of a task's one block (the column after the n first) the first columns, without rows that have a null; of all rows, or of about ``most`` at a time."""
    held, rows = [], 0

    def joined() -> tuple[int, list[np.ndarray]]:
        t = pa.Table.from_batches(held).drop_null()
        return held[0].column(n)[0].as_py(), [np.array(t.column(i).to_numpy()) for i in range(n)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if most and rows >= most:
            yield joined()
            held, rows = [], 0
    if held:
        yield joined()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, id_col: str = "id") -> DataFrame:
    """id, score: parallel edges count each, the mass of nodes without edges is spread evenly, and rounds end when the ranks' change is below the tolerance.

    Hashes of nodes' ids are made to differ; an end of an edge that is no node is told from the nodes by 64 bits.
    """
    ids = cut(nodes.select(F.col(id_col).alias("id")).distinct())
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    graph = Blocks(ids, n)
    files, alone = graph.write(edges)
    rank, lost = None, alone / n
    for i in range(1, iterations + 1):
        new = f"{graph.folder}/rank-{i}"
        change, lost = graph.round(files, rank, new, (1 - damping) / n + damping * lost / n, damping)
        if rank:
            os.remove(rank)
        rank = new
        if change < tolerance:
            break
    for name in itertools.chain(*files.values()):
        for what in ("src", "dst", "n"):
            os.remove(f"{name}.{what}.npy")
    if rank is None:
        return ids.select("id", F.lit(1.0 / n).alias("score"))
    return graph.ranks(rank)
