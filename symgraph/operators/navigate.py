"""Neighbours of a symbol: resolve it, take its edges, filter, group, score, and page."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.similarity import jaro_winkler

PARTS = r"[:. <\-]+"


def layer(rows: DataFrame, kind: str | None, column: str = "id") -> DataFrame:
    """csharp: ids that don't begin with xml:; xml (def): those that do; any other kind doesn't filter."""
    is_xml = F.startswith(F.lower(F.col(column)), F.lit("xml:"))
    return {"csharp": rows.where(~is_xml), "cs": rows.where(~is_xml), "xml": rows.where(is_xml), "def": rows.where(is_xml)}.get((kind or "").lower(), rows)


def neighbours(edges: DataFrame, symbol: str, direction: str) -> DataFrame:
    """id, kind, n of the symbol's edges. On a table sorted or bucketed by src (uses) or dst (used_by) the filter reads only its rows."""
    if direction == "uses":
        rows = edges.where((F.col("src") == symbol) & (F.col("kind") != "CSharpUsedByDef")).select(F.col("dst").alias("id"), "kind", "n")
    elif direction == "used_by":
        rows = edges.where(F.col("dst") == symbol).select(F.col("src").alias("id"), "kind", "n")
    else:
        raise ValueError("direction must be uses or used_by")
    return rows.groupBy("id", "kind").agg(F.sum("n").alias("n"))


def scored(rows: DataFrame, ranks: DataFrame, similarity: Column | None = None) -> DataFrame:
    """Score: rank · scale · weight of the kind · root of the count, times the name's similarity if given."""
    x = rows.join(ranks.select(F.col("id"), F.col("score").alias("rank")), "id", "left")
    value = F.coalesce("rank", F.lit(0.0)) * schema.RANK_SCALE * schema.weight(F.col("kind")) * F.sqrt("n")
    return x.select("id", "kind", "n", (value if similarity is None else value * similarity).alias("score"))


def paged(rows: DataFrame, page: int = 1, size: int = schema.PAGE_SIZE) -> DataFrame:
    """One page by score and id, with the total count and number of pages in each row; the count is a separate aggregate, so only a page's rows are sorted out."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page must be positive and size from 1 to 500")
    total = rows.agg(F.count("*").alias("total_count"))
    part = rows.orderBy(F.desc("score"), F.asc("id"), F.asc("kind")).offset((page - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total_count") / size))  # one row


def query(edges: DataFrame, ranks: DataFrame, symbol: str, direction: str = "uses", kind: str | None = None, page: int = 1, size: int = schema.PAGE_SIZE, name_similarity: bool = True, nodes: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """Neighbours of a symbol (ids as in the graph): id, kind, label, n, score, distance, total_count, pages, and node_id where an index is given."""
    rows = neighbours(edges, symbol, direction) if depth == 1 else n_hop(edges, symbol, direction, depth).withColumn("n", F.lit(1)).select("id", "kind", "n")
    rows = layer(rows, kind)
    similarity = jaro_winkler(F.lit(symbol), F.col("id")) if name_similarity else None
    out = paged(scored(rows, ranks, similarity), page, size).withColumn("label", schema.label(F.col("kind"), direction == "uses")).withColumn("distance", F.lit(depth if depth == 1 else None).cast("int"))
    return out.join(nodes.select("id", "node_id"), "id", "left").orderBy(F.desc("score"), "id", "kind") if nodes is not None else out


#: ids of a level that are broadcast to the edges at most; a larger level is joined by a shuffle
FRONTIER = 100_000


def n_hop(edges: DataFrame, symbol: str, direction: str, depth: int) -> DataFrame:
    """id, kind, distance of all within depth steps; the least distance, and of its kinds the first by name.

    Each level is cut off from the one before, and few enough ids are broadcast to the edges, which are then filtered where they lie.
    """
    from .pagerank import cut

    if depth < 1:
        raise ValueError("depth must be positive")
    a, b = ("src", "dst") if direction == "uses" else ("dst", "src")
    steps = edges.where(F.col("kind") != "CSharpUsedByDef") if direction == "uses" else edges
    steps = steps.select(F.col(a).alias("from"), F.col(b).alias("id"), "kind").where(F.col("id") != symbol)
    found = new = steps.where(F.col("from") == symbol).groupBy("id").agg(F.min("kind").alias("kind")).withColumn("distance", F.lit(1))
    for d in range(2, depth + 1):
        new = cut(new)
        found = new if d == 2 else cut(found.unionByName(new))
        n = new.count()
        if not n:
            return found
        near = new.select(F.col("id").alias("from"))
        near = F.broadcast(near) if n <= FRONTIER else near
        new = steps.join(near, "from").groupBy("id").agg(F.min("kind").alias("kind")).join(found.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
    return found.unionByName(new) if depth > 1 else found


def fuzzy_rank(nodes: DataFrame, text: str, capped: bool = False, id_col: str = "id") -> DataFrame:
    """id, score of nodes that contain all parts of the text: 0.3 similarity, 0.3 coverage, 0.4 share of parts that are whole parts of the id."""
    parts = [p for p in re.split(PARTS, text) if p]
    if not parts:
        return nodes.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rows = nodes.select(F.col(id_col).alias("id"))
    low = F.lower("id")
    for p in parts:
        rows = rows.where(low.contains(p.lower()))
    own = F.split(low, PARTS)
    exact = sum((F.array_contains(own, p.lower()).cast("int") for p in parts), F.lit(0)) / len(parts)
    coverage = F.least(F.lit(float(sum(map(len, parts)))) / F.length("id"), F.lit(1.0))
    return rows.select("id", (0.3 * jaro_winkler(F.lit(text.lower()), low, capped) + 0.3 * coverage + 0.4 * exact).alias("score"))


def resolve(nodes: DataFrame, text: str) -> str | None:
    """The id meant by #node_id, an id, the beginning of an xml: id, or parts of an id; a staged look-up, each stage one small job."""
    if not text or not text.strip():
        return None
    if re.fullmatch(r"#\d+", text):
        row = nodes.where(F.col("node_id") == int(text[1:])).select("id").first()
        return row.id if row else None
    row = nodes.where(F.col("id") == text).select("id").first()
    if row:
        return row.id
    if text.lower().startswith("xml:"):
        row = nodes.where(F.startswith(F.lower("id"), F.lit(text.lower()))).orderBy("node_id").select("id").first()
        if row:
            return row.id
    row = fuzzy_rank(nodes, text).join(nodes, "id").orderBy(F.desc("score"), "node_id").select("id").first()
    return row.id if row else None


def pages(total: int, size: int) -> int:
    return math.ceil(total / size)


def numbered(rows: DataFrame, partition: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
