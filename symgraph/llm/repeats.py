"""What the two substring operators share: bringing equal passages of different documents together, and the way back.

Every run of ``min_words`` words has one *anchor*: the least of the hashes of the k-word sequences in it (winnowing). It
depends on those words alone, so equal runs have equal anchors, wherever they are. A *window* is a maximal row of runs of one
document with the same anchor, with all the words of those runs. Hence

* a passage of min_words words can repeat only where its window's anchor is in two documents (or twice in one, if that counts); all else is left out, without loss,
* windows of one anchor hold all that a repeat can be found from, so anchors are the shuffle key,
* windows with the same words are one row, with how often and where they occur: a passage with thousands of copies is looked at once.

The kernel of an operator gets the windows of a shard (some anchors) and says which runs repeat. Windows of an anchor with more
text than a shard should hold take another exact way: their runs are grouped by all of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, lean, narrowed, written
from .textblock import U, Words, blocks, grams, ints, signed, sliding, spans

#: words of window text in a shard
SHARD_WORDS = 400_000


def windows(words: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """anchor hash, hash of the whole window, first run, last run (word places in the block) of all windows of a block."""
    k = max(1, min_words // 2)
    none = np.zeros(0, np.int64)
    if len(words.hashes) < min_words:
        return none.astype(U), none.astype(U), none, none
    hashes = grams(words.hashes, k)
    bits = U(max(1, len(hashes).bit_length()))
    place = np.arange(len(hashes)).astype(U)
    least = sliding((hashes >> bits << bits) | place, min_words - k + 1)
    runs = np.flatnonzero(words.room(min_words)[: len(least)])
    if not len(runs):
        return none.astype(U), none.astype(U), none, none
    anchor = (least[runs] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.empty(len(runs), bool)
    new[0] = True
    new[1:] = (np.diff(anchor) != 0) | (np.diff(runs) != 1)
    first = runs[new]
    last = runs[np.append(np.flatnonzero(new)[1:], len(runs)) - 1]
    return hashes[anchor[new]], spans(words.hashes, first, last + min_words), first, last


def _anchors(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            anchor, whole, first, last = windows(words, min_words)
            doc = np.searchsorted(words.offsets, first, side="right") - 1
            # rows without words have no window; of equal offsets the last text owns the words
            yield pa.RecordBatch.from_arrays([signed(anchor), signed(whole), pa.array(ints(batch, "doc_id")[doc]), pa.array((first - words.offsets[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["fp", "win", "doc_id", "pos", "runs"])

    return run


def _fetch(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document with the windows wanted of it: their words. Rows with the same id may have other texts, so a cut counts only if it has the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            want = batch.column(batch.schema.get_field_index("want"))
            at = want.offsets.to_numpy()
            rows = want.flatten()
            field = {n: rows.field(n).to_numpy(zero_copy_only=False) for n in ("fp", "win", "pos", "runs")}
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            first = words.offsets[doc] + field["pos"]
            end = first + field["runs"] + min_words - 1
            ok = np.flatnonzero(end <= words.offsets[doc + 1])
            ok = ok[spans(words.hashes, first[ok], end[ok]).view(np.int64) == field["win"][ok]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(field["fp"][ok]), pa.array(field["win"][ok]), pa.array([words.hashes[a:b].tobytes() for a, b in zip(first[ok], end[ok])], pa.binary())],
                ["fp", "win", "words"],
            )

    return run


#: the kernel's answer: runs from..to (counted within the window) of a window repeat; the most occurrences that one of them has
ANSWER = "fp long, win long, run_from int, run_to int, occurrences long"
Kernel = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bool], Iterator[tuple[int, int, int, int]]]


def _shard(kernel: Kernel, min_words: int, within: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, U) for x in rows["words"]]
        found = list(kernel(texts, rows["runs"].to_numpy(), rows["n"].to_numpy(), rows["first_doc"].to_numpy(), rows["last_doc"].to_numpy(), min_words, within))
        at = np.array([x[0] for x in found], np.int64)
        return pd.DataFrame({"fp": rows["fp"].to_numpy()[at], "win": rows["win"].to_numpy()[at], "run_from": [x[1] for x in found], "run_to": [x[2] for x in found], "occurrences": [x[3] for x in found]}).astype({"run_from": "int32", "run_to": "int32", "occurrences": "int64"})

    return run


def _hot_runs(hot: DataFrame, min_words: int, within: bool) -> DataFrame:
    """Windows of a hot anchor: each run by the hash of all its words."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [np.frombuffer(x, U) for x in batch.column(0).to_pylist()]
            runs = batch.column(1).to_numpy().astype(np.int64)
            begin = np.cumsum([0, *(len(t) for t in texts)])[:-1]
            row = np.repeat(np.arange(len(runs)), runs)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            of_row = pa.array(row)
            yield pa.RecordBatch.from_arrays([signed(grams(np.concatenate(texts), min_words)[begin[row] + nth]), *(batch.column(i).take(of_row) for i in range(2, 7)), pa.array(nth.astype(np.int32))], ["run", "fp", "win", "n", "first_doc", "last_doc", "run_from"])

    runs = hot.select("words", "runs", "fp", "win", "n", "first_doc", "last_doc").mapInArrow(explode, "run long, fp long, win long, n long, first_doc long, last_doc long, run_from int")
    real = runs.groupBy("run").agg(F.sum("n").alias("occurrences"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b")).where("occurrences > 1" if within else "a <> b")
    return runs.join(real, "run").select("fp", "win", "run_from", F.col("run_from").alias("run_to"), "occurrences")


def repeated_spans(docs: DataFrame, kernel: Kernel, min_words: int, text_col: str = "text", id_col: str = "doc_id", shard_words: int = SHARD_WORDS, within: bool = False) -> DataFrame:
    """doc_id, start_word, end_word, n_words, occurrences: the maximal spans of words each of whose words is in a run of min_words words that occurs in another document too, or (within) at another place of any."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = written(docs.mapInArrow(_anchors(min_words), "fp long, win long, doc_id long, pos int, runs int"), "anchors")
    shared = anchors.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1" if within else "a <> b").select("fp")
    kept = anchors.join(shared, "fp")
    kept = written(kept.distinct() if within else kept, "shared-anchors")  # a repeated row is one document, with one place for each run
    drop(anchors)
    distinct = kept.groupBy("fp", "win").agg(F.min(F.struct("doc_id", "pos", "runs")).alias("one"), F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))
    distinct = written(distinct.select("fp", "win", "n", F.col("one.doc_id").alias("first_doc"), "last_doc", "one.pos", "one.runs"), "windows")
    sizes = distinct.groupBy("fp").agg(F.sum(F.col("runs").cast("long") + (min_words - 1)).alias("n_words"))
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    n_shards = max(1, -(-total // shard_words))
    hot = sizes.where(F.col("n_words") > shard_words).select("fp", F.lit(True).alias("hot"))
    want = distinct.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct("fp", "win", "pos", "runs")).alias("want"))
    docs = narrowed(docs, distinct.select(F.col("first_doc").alias("doc_id")), "doc_id")
    texts = docs.join(want, "doc_id").select("text", "want").mapInArrow(_fetch(min_words), "fp long, win long, words binary")
    full = texts.join(distinct.select("fp", "win", "n", "first_doc", "last_doc", "runs"), ["fp", "win"]).dropDuplicates(["fp", "win"]).join(hot, "fp", "left")
    full = written(full.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(n_shards))), "window-words")
    cold = full.where("hot IS NULL").groupBy("shard").applyInPandas(_shard(kernel, min_words, within), ANSWER)
    answer = cold.unionByName(_hot_runs(full.where("hot"), min_words, within))
    found = kept.join(answer, ["fp", "win"]).select("doc_id", (F.col("pos") + F.col("run_from")).alias("s"), (F.col("pos") + F.col("run_to") + min_words).alias("e"), "occurrences")
    return islands(found)


def islands(found: DataFrame) -> DataFrame:
    """Spans that touch or overlap in a document are one."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.max("occurrences").alias("occurrences"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "occurrences")
