"""Retrieval of single items: exact, by prefix, or fuzzy; with their text cut to lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import head_lines

KIND_BONUS = {"property": 50.0, "field": 40.0, "method": 10.0}


def query_parts(text: str) -> list[str]:
    return [p.lower() for p in re.split(r"[:. <\-_>]+", text) if len(p) >= 2]


def fuzzy_score(id_: Column, kind: Column, parts: list[str]) -> Column:
    """Types first, most of all if their id ends in the last part; then matched parts, less length and parentheses."""
    low, last = F.lower(id_), parts[-1]
    ends = F.when(low.endswith("." + last) | (low == last), 500.0).when(low.endswith(last), 200.0).otherwise(0.0)
    base = F.when(F.lower(kind) == "type", 1000.0 + ends)
    for k, bonus in KIND_BONUS.items():
        base = base.when(F.lower(kind) == k, bonus)
    matched = sum((low.contains(p).cast("int") for p in parts), F.lit(0))
    return base.otherwise(0.0) + matched * 20.0 - F.length(id_) * 0.2 - F.when(id_.contains("("), 200.0).otherwise(0.0)


def fuzzy(chunks: DataFrame, text: str, id_col: str = "id", kind_col: str = "symbol_kind", lang_col: str = "lang") -> DataFrame:
    """id, score of all candidates for a text: Namespace.Type by the type's name at the end, other texts by their last part anywhere; with xml or def in it only defs."""
    parts = query_parts(text)
    rows = chunks.select(F.col(id_col).alias("id"), F.col(kind_col).alias("kind"), F.col(lang_col).alias("lang"))
    is_xml = text.lower().startswith("xml") or bool({"xml", "def"} & set(parts))
    if is_xml:
        rows, parts = rows.where(F.col("lang") == "xml"), [p for p in parts if p != "xml"]
    if not parts:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("id")
    if not is_xml and len(parts) >= 2 and "." in text:
        rows = rows.where(low.endswith("." + parts[-1]))
    else:
        rows = rows.where(low.contains(parts[-1]))
    return rows.select("id", fuzzy_score(F.col("id"), F.col("kind"), parts).alias("score"))


def find(chunks: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """The chunk meant: by id, else the first with this beginning for xml: ids, else the best fuzzy candidate."""
    exact = chunks.where(F.col(id_col) == text)
    if not exact.isEmpty():
        return exact.limit(1)
    if text.lower().startswith("xml:"):
        start = chunks.where(F.col(id_col).startswith(text))
        if not start.isEmpty():
            return start.orderBy(id_col).limit(1)
    best = fuzzy(chunks, text, id_col).orderBy(F.desc("score"), "id").limit(1)
    return chunks.join(F.broadcast(best.select(F.col("id").alias("__id"))), F.col(id_col) == F.col("__id"), "left_semi").limit(1)  # one row


def item(rows: DataFrame, max_lines: int = 0, text_col: str = "text") -> DataFrame:
    """The rows with their text cut to max_lines (0: all), total_lines, shown_lines and truncated."""
    if max_lines < 0:
        raise ValueError("max_lines must not be negative")
    total = F.size(F.split(F.col(text_col), "\n"))
    shown = F.least(total, F.lit(max_lines)) if max_lines else total
    return rows.withColumns({"total_lines": total, "shown_lines": shown, "truncated": shown < total, text_col: head_lines(F.col(text_col), max_lines)})
