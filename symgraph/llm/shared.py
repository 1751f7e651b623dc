"""Where the operators of this package keep what must outlive a task: the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests on one machine), one of our own. A cluster has to name one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all hosts share")
        folder = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: rows of text in an Arrow batch: with whole documents as rows Spark's 10,000 are tens of MB, held several times over outside the heap
ARROW_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Arrow batches of no more than ARROW_ROWS rows from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` written to the shared folder as Parquet and read back.

    Nothing refers to the shuffles of the finished write any more; Spark's cleaner deletes their files when the driver
    collects garbage, which is asked for here so that they don't stay on the executors' disks for the rest of the job.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: ids that are broadcast at most; more go through a shuffle
BROADCAST_IDS = 1_000_000


def narrowed(docs: DataFrame, ids: DataFrame, column: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ``column`` is among those of ``ids`` (a written table), left out before a shuffle of their texts if there are few enough ids to broadcast; all rows otherwise. A join with ids has to follow."""
    wanted = ids.select(column).distinct()
    if wanted.count() > limit:
        return docs
    return docs.join(F.broadcast(wanted), column, "left_semi")


def without(docs: DataFrame, ids: DataFrame, column: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose ``column`` (cast to long) isn't among the first column of ``ids``. Few enough ids are broadcast, so texts aren't shuffled; rows without an id never are."""
    name = free_name(docs, "unwanted")
    ids = written(ids.select(F.col(ids.columns[0]).alias(name)).distinct(), "unwanted-ids")
    own = F.col(f"`{column}`").cast("long")
    if ids.count() <= limit:
        return docs.join(F.broadcast(ids), own == F.col(name), "left_anti")
    return docs.where(own.isNull()).union(docs.where(own.isNotNull()).join(ids, own == F.col(name), "left_anti"))


def without_repeats(docs: DataFrame, column: str) -> DataFrame:
    """Rows that are equal in every column are one. Only rows whose id is there several times, or null, are shuffled to compare them."""
    own, name = F.col(f"`{column}`").cast("long"), free_name(docs, "repeated")
    repeated = written(docs.where(own.isNotNull()).groupBy(own.alias(name)).count().where("count > 1").select(name), "repeated-ids")
    few = repeated.count() <= BROADCAST_IDS
    ids = F.broadcast(repeated) if few else repeated
    some = docs.where(own.isNull()).union(docs.join(ids, own == F.col(name), "left_semi"))
    odd = [c for c, t in docs.dtypes if "map<" in t or "variant" in t]  # these can't be compared as they are
    keys = {free_name(docs, f"key_of_{i}"): F.to_json(F.struct(F.col(f"`{c}`"))) for i, c in enumerate(odd)}
    some = some.withColumns(keys).dropDuplicates([*(c for c in docs.columns if c not in odd), *keys]).drop(*keys)
    return docs.where(own.isNotNull()).join(ids, own == F.col(name), "left_anti").union(some)


def local_path(path: str) -> str:
    """The path by which a worker opens or memory-maps a file of the shared folder; it has to be mounted on every host."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped models need spark.checkpoint.dir on a file system that is mounted on all hosts")
    return path


def small(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that has to be small; more than ``limit`` rows is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the limit or split the input")
    return rows
