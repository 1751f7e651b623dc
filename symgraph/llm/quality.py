"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, a threshold at a quantile of them.

A document's features are computed by column expressions and one array pass over its words. Of labelled rows (a bounded
sample) each good one is preferred to each of some bad ones; the weights maximise the logistic likelihood of the differences of
features. Scores of all documents follow by a dot product, and the threshold is the given quantile of all labelled good rows' scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, written
from .textblock import blocks, spans

FEATURES = ("letters", "upper", "digits", "marks", "odd_marks", "stops", "word_length", "long_words", "unique_words", "repeated_next", "repeated_lines", "words", "marked_words", "mark_runs")
#: labelled rows that weights are fitted on at most, and pairs made of each good one
TRAIN_ROWS, PAIRS = 20_000, 8

_KIND = np.zeros((5, 256), bool)  # letter, upper, digit, mark, mark other than of sentences
for _c in range(256):
    _KIND[0, _c] = chr(_c).isalpha() if _c < 128 else True
    _KIND[1, _c] = 65 <= _c <= 90
    _KIND[2, _c] = 48 <= _c <= 57
    _KIND[3, _c] = 33 <= _c < 127 and not chr(_c).isalnum()
    _KIND[4, _c] = _KIND[3, _c] and chr(_c) not in ".,;:'\"?()-"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, x: the features of each text with words; whole texts, no Python loop over words."""
    for batch, words in blocks(batches, "text", 1 << 20):
        n = words.counts
        some = np.flatnonzero(n)
        if not len(some):
            continue
        first = words.offsets[some]
        of_text = lambda v: np.add.reduceat(v.astype(np.float64), first)
        size = words.ends - words.starts
        sums = [np.append(0, np.cumsum(k[words.data])) for k in _KIND]
        letters, upper, digits, marks, odd = (s[words.ends] - s[words.starts] for s in sums)
        data = np.append(words.data, 0)
        stop = np.isin(data[words.ends - 1], np.frombuffer(b".?!", np.uint8))
        run = np.append(0, np.cumsum(_KIND[3][data[:-1]] & (data[:-1] == data[1:])))
        runs = run[words.ends - 1] - run[words.starts]  # pairs within the word
        text = words.texts()
        again = np.append(False, (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1]))
        order = np.lexsort((words.hashes, text))
        new = np.append(True, (words.hashes[order][1:] != words.hashes[order][:-1]) | (text[order][1:] != text[order][:-1]))
        unique = np.bincount(text[order][new], minlength=len(n))[some]
        # lines with words, each by the hash of all of them
        breaks = np.append(0, np.cumsum(words.data == 10))
        lead = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])))
        line = spans(words.hashes, lead, np.append(lead[1:], len(words.hashes)))
        order = np.lexsort((line, text[lead]))
        same = np.append(False, (line[order][1:] == line[order][:-1]) & (text[lead][order][1:] == text[lead][order][:-1]))
        lines = np.bincount(text[lead], minlength=len(n))[some]
        again_lines = np.bincount(text[lead][order][same], minlength=len(n))[some]
        k, chars = n[some].astype(np.float64), of_text(size)
        x = np.stack(
            [of_text(letters) / chars, of_text(upper) / chars, of_text(digits) / chars, of_text(marks) / chars, of_text(odd) / chars, of_text(stop) / k, np.minimum(chars / k, 30) / 10, of_text(size > 20) / k, unique / k, of_text(again) / k, again_lines / lines, np.minimum(np.log1p(k), 8) / 8, of_text(odd > 0) / k, of_text(runs > 0) / k],
            1,
        )
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], ["doc_id", "x"])


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 0, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights with the greatest penalised likelihood of good > bad over `pairs` random bad ones for each good one, and as many good ones for each bad one, by Newton's method."""
    if not len(good) or not len(bad):
        return np.zeros(good.shape[1] if good.ndim == 2 else len(FEATURES))
    r = np.random.default_rng(seed)
    d = np.concatenate([np.repeat(good, pairs, 0) - bad[r.integers(0, len(bad), len(good) * pairs)], good[r.integers(0, len(good), len(bad) * pairs)] - np.repeat(bad, pairs, 0)])
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        g = d.T @ p / len(d) - ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 10 / (np.abs(step).max() + 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = 0.005, max_rows: int = TRAIN_ROWS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", label_id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, keep: one row for each input row; keep where the score is at least the threshold.

    The threshold is the ``quantile`` of the scores of all labelled good rows (label 1), exactly. Only the weights are fitted on a
    sample: at most ``max_rows`` labelled rows, the first by a hash of their ids. An id with several labels counts as good only if all
    of them are.

    Null and empty texts, and texts without words, have a null score and aren't kept. Null ids stay null and are scored;
    repeated rows are scored each. Without labelled rows of both kinds all scores are 0 and all texts with words are kept. Other
    columns are ignored, whatever their names. An empty table gives no rows. Texts of any length are read whole.
    """
    if not 0 <= quantile <= 1:
        raise ValueError("quantile must be from 0 to 1")
    lean(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # bounded by max_rows
    sample = train.select("doc_id", "text").mapInArrow(features, "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id").select("x", "y").collect()
    x, y = np.array([r.x for r in sample]).reshape(len(sample), len(FEATURES)), np.array([r.y for r in sample], int)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    w = bradley_terry(x[y == 1], x[y == 0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in blocks(iter([batch]), "text", 1 << 20):
                total = np.full(part.num_rows, np.nan)
                for found in features(iter([part])):
                    values = found.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
                    total[np.flatnonzero(words.counts)] = (values * w).sum(1)  # the same in any block, unlike a matrix product
                none = np.isnan(total)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(total, mask=none)], ["doc_id", "exact"])

    scored = written(rows.mapInArrow(score, "doc_id long, exact double"), "quality-scores")
    good = scored.join(marked.where("y = 1"), "doc_id").agg(F.percentile("exact", F.lit(quantile))).first()[0]
    threshold = good - 1e-9 if good is not None and w.any() else float("-inf")
    return scored.select("doc_id", F.round("exact", 9).alias("score"), F.coalesce(F.col("exact") >= threshold, F.lit(False)).alias("keep"))
