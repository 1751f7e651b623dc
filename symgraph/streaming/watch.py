"""A stream of source files: new and changed files are parsed as they come, and their chunks upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index
from ..sources import files


def watch(spark: SparkSession, root: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert the chunks of files that appear below a folder into the index's table. once: all that is there now, then end.

    A batch that runs again after a failure replaces the same files' chunks by the same, so each file counts once.
    """
    index = Index(spark, path)
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", files.GLOB).load(root)
    source = source.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))

    def upsert(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("text", "mtime").alias("text")).persist()
        rows = files.chunks(files.parse_files(newest))
        if index.has("chunks"):
            rows = index.table("chunks").join(newest.select("path"), "path", "left_anti").unionByName(rows)
        index.put(rows, "chunks", "lang")
        newest.unpersist()

    writer = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
