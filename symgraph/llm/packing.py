"""Packing documents into windows of tokens by minimum bin slack.

Only lengths matter for packing, and there are no more different lengths than the window has tokens, at any size of the corpus.
So the plan is made on the multiset of lengths: each window takes the longest piece that is left and, by a subset-sum dynamic
program over bitsets, the multiset of the others whose total is closest to what it leaves; the counts are traced back through the
bitsets. The same filling is used for as many windows as its counts allow. Then the pieces of each length, numbered in
the order of their documents, are dealt to the plan's places by a join on ranges of numbers.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def closest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is the greatest of at most `room`; of several the one with the longest pieces.

    Bit s of a stage's bitset: the lengths so far can sum to s. A count of c is added in parts of 1, 2, 4, ... pieces.
    """
    stages: list[tuple[int, int, int]] = []  # length, pieces of the part, bitset before it
    reach, limit = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            stages.append((length, part, reach))
            reach |= (reach << (length * part)) & limit
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, part, before in reversed(stages):
        if not before >> total & 1:
            total -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and the number of windows with each, until no piece is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    out = []
    while order:
        longest = order[-1]
        left[longest] -= 1
        used = closest(capacity - longest, left)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                order.pop(bisect_left(order, k))
        out.append((used, times))
    return out


def word_count(text: Column) -> Column:
    """Words split at ASCII blanks and control characters, as a length in tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("long")


def pack_windows(docs: DataFrame, capacity: int = 2048, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """window_id, doc_id, piece, length, start (in the document), place (in the window): where each piece of each document goes.

    A document's length is its number of words (or ``length_col``). One longer than ``capacity`` is cut into full pieces and a
    rest. Every token of every document is in one window, none of which is overfull. Window ids are 0, 1, ... without gaps.

    Texts without words, null texts and lengths that are null or not positive have no piece. Null ids are packed like
    others; repeated rows are packed each. Ties (pieces of one length) are dealt by doc_id and content, so equal input gives
    equal windows. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    length = F.col(length_col).cast("long") if length_col else word_count(F.col(text_col))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n"), F.xxhash64(F.col(text_col).cast("string") if text_col in docs.columns else length).alias("h")).where("n > 0")
    sized = written(sized, "lengths")
    n_buckets = max(1, -(-sized.count() // bucket_rows))
    full = F.floor(F.col("n") / capacity).cast("int")
    rest = sized.where(F.col("n") % capacity > 0).select("doc_id", "h", full.alias("piece"), (F.col("n") % capacity).cast("int").alias("length"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_buckets)).cast("int").alias("bucket"))
    # full pieces: a window each
    whole = sized.where(F.col("n") >= capacity).select("doc_id", "h", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).alias("length"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(n_buckets)).cast("int").alias("bucket"))
    pieces = whole.unionByName(rest)
    sizes = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("k")), "piece-counts")
    counts = {r.length: r.k for r in sizes.groupBy("length").agg(F.sum("k").alias("k")).collect()}  # no more rows than the capacity
    rows, window, dealt = [], 0, dict.fromkeys(counts, 0)
    for used, times in plan(counts, capacity):
        place = 0
        for k in sorted(used, reverse=True):
            rows.append((k, dealt[k], dealt[k] + used[k] * times, window, used[k], place))
            dealt[k] += used[k] * times
            place += k * used[k]
        window += times
    # pieces of a length are numbered within their bucket, after those of the buckets before
    before = sizes.withColumn("first", F.sum("k").over(Window.partitionBy("length").orderBy("bucket")) - F.col("k")).drop("k")
    numbered = pieces.withColumn("i", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "h", "piece")) - 1)
    numbered = numbered.join(before, ["length", "bucket"]).withColumn("number", F.col("first") + F.col("i"))
    return _deal(spark, numbered, rows, capacity)


def _deal(spark, numbered: DataFrame, rows: list[tuple], capacity: int) -> DataFrame:
    """The plan has a few rows for each length; they are looked up by binary search in arrays that every task holds."""
    by_length: dict[int, list[tuple]] = {}
    for k, *r in rows:
        by_length.setdefault(k, []).append(r)
    table = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in by_length.items()})

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            window, place = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, _, base, each, offset = table.value[int(k)]
                i = np.searchsorted(first, number[at], side="right") - 1
                nth = number[at] - first[i]
                window[at] = base[i] + nth // each[i]
                place[at] = offset[i] + nth % each[i] * k
            piece = batch.column(batch.schema.get_field_index("piece")).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window), batch.column(batch.schema.get_field_index("doc_id")), pa.array(piece.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(piece * capacity), pa.array(place.astype(np.int32))],
                ["window_id", "doc_id", "piece", "length", "start", "place"],
            )

    return numbered.select("doc_id", "piece", "length", "number").mapInArrow(run, "window_id long, doc_id long, piece int, length int, start long, place int")
