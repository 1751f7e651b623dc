"""Connected components of an undirected graph of ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long) -> id, label: the least id of its component. Rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        new = labels.join(near, "id").join(hop, "label").select("id", F.least("label", "near", "hop").alias("new"), "label")
        new = written(new, "labels")
        if new.where("new <> label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", F.col("new").alias("label"))
