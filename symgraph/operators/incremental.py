"""Changes of files, upserts, and the decision to rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.5
PARTS = ("lexical", "vectors", "graph")


def changed(files: DataFrame, known: DataFrame, incremental: bool = True, tolerance: float = TOLERANCE) -> DataFrame:
    """Files (path, mtime) that are new or whose time differs by more than the tolerance; all when not incremental."""
    if not incremental:
        return files
    old = known.select("path", F.col("mtime").alias("__old"))
    seconds = F.abs(F.unix_micros("mtime") - F.unix_micros("__old")) / 1e6
    return files.join(old, "path", "left").where(F.col("__old").isNull() | (seconds > tolerance)).drop("__old")


def deleted(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("path"), "path", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows in place of those of the same key; of several new rows with a key the caller keeps one first."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def last_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by max_by: partial aggregates, no sort."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r"))
    return best.select(key, *(F.col(f"__r.{c}").alias(c) for c in others))


def to_rebuild(changes: DataFrame, missing: set[str], force: str | None = None) -> set[str]:
    """Which of the lexical index, vectors and graph to make again: what is forced (all for "" or all), what is missing, or all after any change."""
    if force is not None:
        if force in ("", "all"):
            return set(PARTS)
        chosen = {"lexical": "lexical", "embed": "vectors", "vectors": "vectors", "graph": "graph"}.get(force)
        if not chosen:
            raise ValueError(f"unknown part {force}")
        return {chosen} | missing
    return set(PARTS) if missing == set(PARTS) or not changes.isEmpty() else set(missing)
