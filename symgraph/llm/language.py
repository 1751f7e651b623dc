"""Language of words in code-switched text by a linear-chain conditional random field, and of documents by their words.

A word's features are its affixes (1 to 3 bytes at either end), its byte n-grams (2 to 4) and the lexicons of the languages that
it is in; their weights and the transitions between languages are learned by gradient ascent on the conditional likelihood
of mixed sequences. Words are labelled by their posteriors from the forward-backward algorithm over the whole text.

Forward-backward runs over all texts of a block at once: texts are cut into chunks, the product of each chunk's transition
matrices is built in step for all chunks, the messages between chunks follow along each text, and the messages within the
chunks again in step. That is exact, and the number of array operations doesn't grow with the length of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .shared import free_name, lean
from .textblock import U, Words, blocks, mix, split

TABLE = 1 << 18
CHUNK = 64
#: labelled rows that the model is fitted on at most, and of these for each language
TRAIN_ROWS, TRAIN_PER_LANGUAGE = 2000, 150


def letters(text: Column) -> Column:
    """Lower-case words of letters and marks, split by single blanks."""
    return F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}]+", " ")


def packed(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on as one number."""
    out = np.zeros(len(at), U)
    for i in range(k):
        out |= data[at + i].astype(U) << U(8 * i)
    return out


def feature_rows(words: Words, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for the words at the places `unique`, and the word of each (in order)."""
    starts, ends = words.starts[unique], words.ends[unique]
    size = ends - starts
    begin = np.cumsum(size) - size
    data = words.data[np.repeat(starts - begin, size) + np.arange(size.sum())]
    word = np.repeat(np.arange(len(unique)), size)
    left = np.repeat(begin + size, size) - np.arange(len(data))
    rows, owner = [], []
    for kind, k in enumerate((2, 3, 4)):
        at = np.flatnonzero(left >= k)
        rows.append(mix(packed(data, at, k) + U((kind + 1) << 56)))
        owner.append(word[at])
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        rows += [mix(packed(data, begin[long], k) + U((3 + k) << 56)), mix(packed(data, begin[long] + size[long] - k, k) + U((6 + k) << 56))]
        owner += [long, long]
    row, owned = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owned, kind="stable")
    return (row[order] % U(TABLE)).astype(np.int64), owned[order]


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # table x languages
    lexicon: list[np.ndarray]  # sorted word hashes of each language
    lexicon_weights: np.ndarray  # lexicon x languages
    start: np.ndarray
    transitions: np.ndarray

    def in_lexicons(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.lexicon)), np.float32)
        for i, known in enumerate(self.lexicon):
            if len(known):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out[:, i] = known[place] == hashes
        return out

    def scores(self, words: Words) -> np.ndarray:
        """words x languages: each word's own score. Features are looked up once for each different word."""
        _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        row, owner = feature_rows(words, first)
        at = np.searchsorted(owner, np.arange(len(first)))
        total = np.add.reduceat(self.weights[row], at, axis=0) + self.in_lexicons(words.hashes[first]) @ self.lexicon_weights
        return total[inverse]


def posteriors(scores: np.ndarray, offsets: np.ndarray, start: np.ndarray, transitions: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """words x labels: the probability of each label given the whole text. offsets: where each text begins, and the end of all."""
    n, m = scores.shape
    if not n:
        return scores
    count = np.diff(offsets)
    per_text = -(-count // chunk)
    first_chunk = np.cumsum(per_text) - per_text
    chunks = int(per_text.sum())
    rank = np.arange(chunks) - np.repeat(first_chunk, per_text)
    begin = np.repeat(offsets[:-1], per_text) + rank * chunk
    size = np.minimum(np.repeat(offsets[1:], per_text) - begin, chunk)
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    pi = np.exp(start - start.max()).astype(np.float32)
    place = np.minimum(begin[:, None] + np.arange(chunk), n - 1)
    at = e[place]  # chunks x steps x labels
    # products of the chunks' matrices
    p = np.broadcast_to(np.eye(m, dtype=np.float32), (chunks, m, m)).copy()
    opening = rank == 0
    for t in range(chunk):
        going = size > t
        step = (p.reshape(-1, m) @ a).reshape(chunks, m, m) * at[:, t, None, :]
        if t == 0:
            step[opening] = (pi * at[opening, 0])[:, None, :]
        step /= step.max(axis=(1, 2), keepdims=True) + np.float32(1e-30)
        p = np.where(going[:, None, None], step, p)
    # messages into each chunk from the left, and from the right
    left, right = np.full((chunks, m), 1 / m, np.float32), np.ones((chunks, m), np.float32)
    last_chunk = first_chunk + per_text - 1
    some = np.flatnonzero(per_text)
    for r in range(1, int(per_text.max())):
        some = some[per_text[some] > r]
        c = first_chunk[some] + r
        v = np.einsum("ci,cij->cj", left[c - 1], p[c - 1])
        left[c] = v / v.sum(1, keepdims=True)
        c = last_chunk[some] - r
        v = np.einsum("cij,cj->ci", p[c + 1], right[c + 1])
        right[c] = v / v.sum(1, keepdims=True)
    alpha = np.empty((chunks, chunk, m), np.float32)
    v = left
    for t in range(chunk):
        step = (v @ a) * at[:, t]
        if t == 0:
            step[opening] = pi * at[opening, 0]
        v = step / step.sum(1, keepdims=True)
        alpha[:, t] = v
    v = right.copy()
    for t in range(chunk - 1, -1, -1):
        going = size > t
        alpha[:, t] *= v
        step = (at[:, t] * v) @ a.T
        v = np.where(going[:, None], step / step.sum(1, keepdims=True), v)
    out = alpha[np.arange(chunk)[None, :] < size[:, None]]
    return out / out.sum(1, keepdims=True)


def mixed_sequences(texts: list[tuple[Words, int]], length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places (into all texts' words together) and labels of code-switched sequences: pieces of 5 to 40 words of all texts, each used once, in random order."""
    r = np.random.default_rng(seed)
    pieces, base = [], 0
    for words, label in texts:
        at = 0
        while at < len(words.hashes):
            n = int(r.integers(5, 41))
            pieces.append((np.arange(base + at, base + min(at + n, len(words.hashes))), label))
            at += n
        base += len(words.hashes)
    order = r.permutation(len(pieces))
    place = np.concatenate([pieces[i][0] for i in order])
    label = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
    n = len(place) // length * length
    return place[:n].reshape(-1, length), label[:n].reshape(-1, length)


def fit(rows: list[tuple[str, str]], epochs: int = 4, seed: int = 0, lexicon_size: int = 2000, length: int = 64, rate: float = 0.2) -> Crf:
    """rows: (text of letters, language). AdaGrad on mini-batches of the exact gradient: observed less expected features and transitions."""
    languages = sorted({lang for _, lang in rows})
    m = len(languages)
    words = split(pa.array([t for t, _ in rows], pa.large_string()))
    label_of = np.repeat([languages.index(lang) for _, lang in rows], words.counts)
    unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    lexicon = []
    for k in range(m):
        times = np.bincount(inverse[label_of == k], minlength=len(unique))
        lexicon.append(np.sort(unique[np.argsort(-times, kind="stable")[: min(lexicon_size, int((times > 1).sum()))]]))
    crf = Crf(languages, np.zeros((TABLE, m), np.float32), lexicon, np.zeros((m, m), np.float32), np.zeros(m), np.zeros((m, m)))
    if m < 2 or not len(words.hashes):
        return crf
    row, owner = feature_rows(words, first)
    at = np.append(np.searchsorted(owner, np.arange(len(unique))), len(owner))
    in_lexicon = crf.in_lexicons(unique)
    parts = [(Words(words.data, words.hashes[a:b], words.starts[a:b], words.ends[a:b], np.array([0, b - a])), languages.index(lang)) for (a, b), (_, lang) in zip(zip(words.offsets[:-1], words.offsets[1:]), rows)]
    sums = {k: np.full_like(getattr(crf, k), 1e-6, dtype=np.float64) for k in ("weights", "lexicon_weights", "transitions", "start")}
    length = max(2, min(length, len(words.hashes) // 2))
    for epoch in range(epochs):
        place, label = mixed_sequences(parts, length, seed + epoch)
        for lo in range(0, len(place), 64):
            p, y = place[lo : lo + 64], label[lo : lo + 64]
            used, of = np.unique(inverse[p], return_inverse=True)
            of = of.reshape(p.shape)
            size = at[used + 1] - at[used]
            begin = np.cumsum(size) - size
            feature = row[np.repeat(at[used] - begin, size) + np.arange(size.sum())]
            score = np.add.reduceat(crf.weights[feature], begin, axis=0) + in_lexicon[used] @ crf.lexicon_weights
            gradient, pairs = _gradient(score[of], y, crf.start, crf.transitions)
            by_word = np.stack([np.bincount(of.ravel(), gradient[..., k].ravel(), len(used)) for k in range(m)], 1)
            spread = np.repeat(by_word, size, axis=0)
            rows_used, which = np.unique(feature, return_inverse=True)
            g = np.stack([np.bincount(which, spread[:, k], len(rows_used)) for k in range(m)], 1)
            sums["weights"][rows_used] += g**2
            crf.weights[rows_used] += (rate * g / np.sqrt(sums["weights"][rows_used])).astype(np.float32)
            for name, g in (("lexicon_weights", in_lexicon[used].T @ by_word), ("transitions", pairs), ("start", gradient[:, 0].sum(0))):
                sums[name] += g**2
                setattr(crf, name, getattr(crf, name) + rate * g / np.sqrt(sums[name]))
    crf.lexicon_weights = crf.lexicon_weights.astype(np.float32)
    return crf


def _gradient(score: np.ndarray, y: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of one length: observed less expected, of each word's label and of pairs of labels."""
    n, length, m = score.shape
    e = np.exp(score - score.max(2, keepdims=True)) + 1e-12
    a = np.exp(transitions - transitions.max())
    alpha, beta = np.empty((n, length, m)), np.ones((n, length, m))
    v = np.exp(start - start.max()) * e[:, 0]
    for t in range(length):
        if t:
            v = (v @ a) * e[:, t]
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    for t in range(length - 2, -1, -1):
        v = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = v / v.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = np.einsum("ntp,pq,ntq->ntpq", alpha[:, :-1], a, e[:, 1:] * beta[:, 1:])
    pair /= pair.sum((2, 3), keepdims=True)
    observed = np.zeros((m, m))
    np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    return np.eye(m)[y] - post, observed - pair.sum((0, 1))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = TRAIN_ROWS, per_language: int = TRAIN_PER_LANGUAGE) -> Crf:
    """Fit on a bounded sample of labelled rows; texts are used whole.

    Each language has as many rows as the others: the ``per_language`` with the least hashes of id and text, or ``max_rows`` / languages
    if that is fewer. With more languages than ``max_rows``, the commonest are learned. Repeated rows count once; null languages and texts
    without letters aren't labelled rows.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)).alias("h"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()
    if not known:
        return fit([])
    each = min(per_language, max(1, max_rows // len(known)))
    # a bound on the hash leaves about twice the rows wanted of a language, and all of a rare one
    bound = rows.sparkSession.createDataFrame([(r.lang, 1 << 40 if r.different <= 4 * each else int((1 << 40) * 2 * each / r.different)) for r in known], "lang string, bound long")
    few = rows.join(F.broadcast(bound), "lang").where("h < bound")  # a row for each of at most max_rows languages
    hashes: dict[str, list[int]] = {}
    for r in few.select("lang", "h").distinct().collect():
        hashes.setdefault(r.lang, []).append(r.h)
    chosen = rows.sparkSession.createDataFrame([(lang, h) for lang, v in hashes.items() for h in sorted(v)[:each]], "lang string, h long")
    sample = few.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", letters(F.col("text")).alias("t")).dropDuplicates(["lang", "h"]).collect()  # at most max_rows
    return fit([(r.t, r.lang) for r in sorted(sample, key=lambda r: (r.h, r.lang))])


#: what ``labelled`` adds to each row
ADDED = StructType([StructField("language", StringType()), StructField("share", DoubleType()), StructField("confidence", DoubleType()), StructField("n_words", LongType()), StructField("n_switches", LongType())])


def _label(model, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Crf = model.value
        m = len(crf.languages)
        for batch, words in blocks(batches, name, 1 << 20):
            n = words.counts
            mass, label, switches = np.zeros((len(n), m)), np.zeros(len(words.hashes), np.int64), np.zeros(len(n), np.int64)
            votes = np.zeros((len(n), m))
            some = np.flatnonzero(n)
            if m and len(some):
                post = posteriors(crf.scores(words), words.offsets, crf.start, crf.transitions)
                mass[some] = np.add.reduceat(post, words.offsets[some], axis=0)
                label = post.argmax(1)
                text = words.texts()
                votes = np.bincount(text * m + label, minlength=len(n) * m).reshape(-1, m)
                change = (label[1:] != label[:-1]) & (text[1:] == text[:-1])
                switches = np.bincount(text[1:][change], minlength=len(n))
            top = mass.argmax(1) if m else np.zeros(len(n), np.int64)
            none = (n == 0) | (m == 0)
            divisor, at = np.maximum(n, 1), np.arange(len(n))
            share = votes[at, top] / divisor if m else np.zeros(len(n))
            sure = mass[at, top] / divisor if m else np.zeros(len(n))
            names = pa.array(crf.languages, pa.string()).take(pa.array(np.where(none, None, top).tolist(), pa.int64())) if m else pa.nulls(len(n), pa.string())
            i = batch.schema.get_field_index(name)
            added = pa.StructArray.from_arrays([names, pa.array(share, mask=none), pa.array(sure, mask=none), pa.array(n.astype(np.int64)), pa.array(switches.astype(np.int64))], ADDED.names)
            yield batch.set_column(i, pa.field(name, added.type), added)

    return run


def labelled(rows: DataFrame, crf: Crf, name: str, text_col: str = "text") -> DataFrame:
    """The rows with a column more, ``name``, of which they have none: a struct as in ADDED."""
    lean(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast(crf)
    schema = StructType([*rows.schema.fields, StructField(name, ADDED)])
    return rows.withColumn(name, letters(F.col(f"`{text_col}`"))).mapInArrow(_label(model, name), schema)


def accepted(of: Column, min_share: float) -> Column:
    return (of["n_words"] > 0) & (F.coalesce(of["share"], F.lit(0.0)) >= min_share)


def identify_language(docs: DataFrame, min_share: float = 0.4, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", crf: Crf | None = None, max_rows: int = TRAIN_ROWS, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, language, share, confidence, n_words, n_switches, accepted: one row for each input row.

    ``language`` has the greatest sum of posteriors over the text's words (of equal ones the first by name), ``share`` the part of
    the words that are labelled with it, ``confidence`` the mean posterior, ``n_switches`` how often the label changes. A
    document is accepted if ``share`` is at least ``min_share``. The model is fitted on ``lang_col`` (see ``train`` for the bounds ``max_rows`` and
    ``per_language``) unless given.

    Null and empty texts, and texts without letters, have no language, null share and confidence, and aren't accepted; with
    no labelled row at all that holds for every text. Null ids stay null, repeated rows are labelled each. Other columns are
    ignored, whatever their names. An empty table gives no rows. Texts of any length are read whole.
    """
    crf = crf or train(docs, text_col, lang_col, id_col, max_rows, per_language)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return labelled(rows, crf, "of").select("doc_id", "of.*", accepted(F.col("of"), min_share).alias("accepted"))


def in_a_language(docs: DataFrame, min_share: float = 0.4, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = TRAIN_ROWS, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is accepted (see identify_language), with their columns as they are.

    Null and empty texts, and texts without letters, go; rows without an id are judged by their texts; repeated rows stay repeated. Other columns
    may have any names and types. An empty table gives none, as does one without a labelled row.
    """
    name = free_name(docs, "language_of")
    out = labelled(docs, train(docs, text_col, lang_col, id_col, max_rows, per_language), name, text_col)
    return out.where(accepted(F.col(name), min_share)).drop(name)
