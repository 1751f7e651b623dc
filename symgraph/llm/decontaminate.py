"""Benchmark decontamination by SimHash windows, Hamming blocks and weighted shingles.

A window has as many words as the item that it is compared with. Its SimHash (128 signs of the weighted sum of its shingles' hash
bits) has to be within ``radius`` bits of the item's; a multi-index of radius + 1 blocks of bits finds all such pairs, as two
fingerprints that differ in at most radius bits are equal in one of the blocks. Where blocks are so short that they would propose
more pairs than there are, which they are at low thresholds, all pairs' fingerprints are compared. Pairs are then verified by the
weighted Jaccard similarity of their multisets of shingles, exactly.

A window of which too little weight is in the items' shingles cannot reach the threshold; such windows are left out before
they are hashed, without loss. A text is searched for where enough of that weight is together at all, and only those places are
looked at for each item's number of words (``promising``). Windows overlap, so the signed weights of each bit are summed once along the
text, and a window's sum is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small, without
from .textblock import U, Words, blocks, grams, ints, mix, split

#: bits of a fingerprint, of which a block's key has at most KEY_BITS
BITS, KEY_BITS = 128, 32
#: items that the driver and each task hold at most; more are an error, to be split over several runs
MAX_ITEMS = 200_000
#: places of a text whose windows are hashed at a time; windows and items whose fingerprints are compared at a time; cells of shingle weights
AREA, CHUNK, ITEMS_AT_ONCE, CELLS = 20_000, 20_000, 128, 1 << 20


def shingled(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and weight of the shingle of `size` words from each place on. The weight is its number of bytes, so that rare long words count more than short common ones."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    length = np.cumsum(np.append(0, words.ends - words.starts))
    return grams(words.hashes, size), length[size:] - length[:-size]


def signed_weights(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each shingle its weight for each bit of the fingerprint, negative where the bit of its hash is 0."""
    both = np.stack([mix(values), mix(values ^ U(0x9E3779B97F4A7C15))], 1)
    bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weights[:, None].astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """rows x bits of summed weights -> rows x two numbers."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(U)


def simhash(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The fingerprint of one multiset of shingles."""
    return fingerprint(signed_weights(values, weights).sum(0)[None])[0]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two multisets of shingles: the sum of the lesser weights over the sum of the greater."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(at[: len(a)], wa, len(values))
    y = np.bincount(at[len(a) :], wb, len(values))
    total = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / total) if total else 0.0


def radius_for(threshold: float) -> int:
    """The bits that windows at the threshold differ in from their item, and three standard deviations more.

    Weighted Jaccard t of multisets of equal weight is a cosine of 2t / (1 + t), and a bit differs with probability angle / pi.
    """
    p = np.arccos(np.clip(2 * threshold / (1 + threshold), 0, 1)) / np.pi
    return min(BITS - 1, int(np.ceil(BITS * p + 3 * np.sqrt(BITS * p * (1 - p)))))


def block_edges(radius: int) -> list[tuple[int, int]]:
    """radius + 1 blocks of the bits, as even as can be; of a long one the first KEY_BITS, which are equal if all of it is."""
    cut = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, min(hi, lo + KEY_BITS)) for lo, hi in zip(cut[:-1], cut[1:])]


def block_keys(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    return [bits[:, lo:hi] @ (1 << np.arange(hi - lo)) for lo, hi in block_edges(radius)]


@dataclass
class Items:
    """The items, each with the shingles of all its words; by_size: the items of each number of words."""

    ids: list[int]
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    words: np.ndarray
    fingerprints: np.ndarray  # items x 2
    known: np.ndarray  # all shingles, sorted
    size: int
    radius: int
    threshold: float
    by_size: dict[int, np.ndarray] = field(default_factory=dict)
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of n words whose fingerprints differ in at most radius bits: all of them."""
        items = self.by_size[n]
        window, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if sum(0.5 ** (hi - lo) for lo, hi in block_edges(self.radius)) >= 1:
            for lo in range(0, len(prints), CHUNK):
                for k in range(0, len(items), ITEMS_AT_ONCE):
                    w, i = np.nonzero(apart(prints[lo : lo + CHUNK, None], self.fingerprints[items[k : k + ITEMS_AT_ONCE]]) <= self.radius)
                    window.append(w + lo)
                    item.append(items[k + i])
            return np.concatenate(window), np.concatenate(item)
        if n not in self.index:
            keys = block_keys(self.fingerprints[items], self.radius)
            order = [np.argsort(k, kind="stable") for k in keys]
            self.index[n] = [(k[o], items[o]) for k, o in zip(keys, order)]
        for part, (values, of) in zip(block_keys(prints, self.radius), self.index[n]):
            first, last = np.searchsorted(values, part), np.searchsorted(values, part, side="right")
            count = last - first
            w = np.repeat(np.arange(len(prints)), count)
            i = of[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
            close = apart(prints[w], self.fingerprints[i]) <= self.radius
            window.append(w[close])
            item.append(i[close])
        pairs = np.unique(np.stack([np.concatenate(window), np.concatenate(item)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def prepare(rows: list, size: int, radius: int, threshold: float) -> Items:
    """rows: (id, lower-case text). Items with fewer words than a shingle are left out."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    words = split(pa.array([t for _, t in rows], pa.large_string()))
    values, weights = shingled(words, size)
    keep = [k for k in range(len(rows)) if words.counts[k] >= size]
    shingles = [values[words.offsets[k] : words.offsets[k + 1] - size + 1] for k in keep]
    weight = [weights[words.offsets[k] : words.offsets[k + 1] - size + 1] for k in keep]
    prints = np.array([simhash(v, w) for v, w in zip(shingles, weight)], U).reshape(-1, 2)
    n = words.counts[keep] if keep else np.zeros(0, np.int64)
    known = np.unique(np.concatenate(shingles)) if keep else np.zeros(0, U)
    return Items([rows[k][0] for k in keep], shingles, weight, n, prints, known, size, radius, threshold, {int(m): np.flatnonzero(n == m) for m in np.unique(n)}, np.array([w.sum() for w in weight], np.int64))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted known ones; a bit table keeps most others from being looked up."""
    bits = max(16, int(len(known)).bit_length() + 4)
    table = np.zeros(1 << bits, bool)
    table[(known >> U(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(values >> U(64 - bits)).astype(np.int64)])
    out = np.zeros(len(values), bool)
    if len(maybe):
        place = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        out[maybe] = known[place] == values[maybe]
    return out


def promising(words: Words, shared: np.ndarray, every: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of words, starts and ends (words of the block) of the windows that may reach the threshold with an item of as many words.

    shared and every: the running sums of the shingles' weights, of those that items have and of all. Similarity is at most shared weight /
    max(window's weight, item's weight). Numbers of words are taken together by their powers of two: where the longest windows hold
    too little for the lightest item, so do all shorter ones in them. A text shorter than the item is a window of its own.
    """
    places, more = len(shared) - 1, items.size - 1
    octaves: dict[int, list[int]] = {}
    for n in items.by_size:
        octaves.setdefault(n.bit_length(), []).append(n)
    text_of = None
    for sizes in octaves.values():
        least = min(int(items.totals[items.by_size[n]].min()) for n in sizes)
        longest = min(max(sizes) - more, places)
        weight = shared[longest:] - shared[: places + 1 - longest]
        tail = shared[-1] - shared[places + 1 - longest : places]
        starts = np.flatnonzero(np.append(weight, tail)[:places] >= items.threshold * least - 1e-9)
        if not len(starts):
            continue
        if text_of is None:
            text_of = words.texts()
        left = words.offsets[text_of[starts] + 1] - starts
        opens = words.offsets[text_of[starts]] == starts
        for n in sorted(sizes):
            whole = left >= n
            ok = np.flatnonzero(whole | (opens & (left >= items.size)))
            first = starts[ok]
            last = first + np.minimum(n, left[ok])
            has, total = shared[last - more] - shared[first], every[last - more] - every[first]
            keep = has >= items.threshold * np.maximum(total, items.totals[items.by_size[n]].min()) - 1e-9
            if keep.any():
                yield n, first[keep], last[keep]


def verified(first: np.ndarray, last: np.ndarray, item: np.ndarray, rank: np.ndarray, weights: np.ndarray, every: np.ndarray, items: Items) -> np.ndarray:
    """The weighted Jaccard similarity of pairs of a window of shingles first..last - 1 and an item, exactly.

    rank: of each shingle its place among the known ones, their number for others.
    """
    out = np.zeros(len(item))
    number = np.full(len(items.known) + 1, -1)
    order = np.argsort(item, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(item[order]) != 0)) if len(order) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(order)).astype(int)):
        i = item[order[lo]]
        own, at = np.unique(np.searchsorted(items.known, items.shingles[i]), return_inverse=True)
        has = np.bincount(at, items.weights[i], len(own))
        number[own] = np.arange(len(own))
        step = max(1, CELLS // len(has))
        for k in range(lo, hi, step):
            pairs = order[k : min(k + step, hi)]
            size = last[pairs] - first[pairs]
            row = np.repeat(np.arange(len(pairs)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[pairs], size)
            which = number[rank[place]]
            hit = which >= 0
            held = np.bincount(row[hit] * len(has) + which[hit], weights[place[hit]], len(pairs) * len(has)).reshape(len(pairs), -1)
            shared = np.minimum(held, has).sum(1)
            out[pairs] = shared / (every[last[pairs]] - every[first[pairs]] + items.totals[i] - shared)
        number[own] = -1
    return out


def matches(words: Words, items: Items) -> Iterator[tuple[int, int, int, int, float]]:
    """text, item, first and last word (in the block), similarity of each window that passes."""
    values, weights = shingled(words, items.size)
    if not len(values) or not len(items.ids):
        return
    more = items.size - 1
    hit = member(values, items.known) & words.room(items.size)[: len(values)]
    every = np.append(0, np.cumsum(weights))
    found = list(promising(words, np.append(0, np.cumsum(hit * weights)), every, items))
    if not found:
        return
    rank = np.full(len(values), len(items.known))
    rank[hit] = np.searchsorted(items.known, values[hit])
    texts = words.texts()
    for lo in range(0, len(values), AREA):  # windows that begin in a stretch of the block
        here = [(n, *(x[np.searchsorted(first, lo) : np.searchsorted(first, lo + AREA)] for x in (first, last))) for n, first, last in found]
        here = [(n, first, last - more) for n, first, last in here if len(first)]
        if not here:
            continue
        # the places that any of them has, side by side
        begin, end = min(int(first[0]) for _, first, _ in here), max(int(last.max()) for _, _, last in here)
        covered = np.zeros(end - begin + 1, np.int64)
        for _, first, last in here:
            np.add.at(covered, first - begin, 1)
            np.add.at(covered, last - begin, -1)
        used = np.flatnonzero(np.cumsum(covered) > 0)
        where = np.zeros(end - begin + 2, np.int64)
        where[used + 1] = 1
        where = np.cumsum(where)  # how many used places are before each
        sums = np.zeros((len(used) + 1, BITS), np.int32)
        np.cumsum(signed_weights(values[begin + used], weights[begin + used]), axis=0, out=sums[1:])
        for n, first, last in here:
            for k in range(0, len(first), CHUNK):
                a, b = first[k : k + CHUNK], last[k : k + CHUNK]
                at = where[a - begin]
                window, item = items.near(n, fingerprint(sums[at + b - a] - sums[at]))
                j = verified(a[window], b[window], item, rank, weights, every, items)
                for p in np.flatnonzero(j >= items.threshold):
                    s = int(a[window[p]])
                    yield int(texts[s]), int(item[p]), s, int(b[window[p]]) + more, float(j[p])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, radius: int | None = None, shingle_words: int = 2, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: for each document and benchmark item the best window (of equal ones the first).

    A window of the document with as many words as the item (lower case, split at ASCII blanks), or all of a document that has fewer,
    matches if the SimHashes differ in at most ``radius`` of 128 bits and the weighted Jaccard similarity of ``shingle_words``-word
    shingles is at least ``threshold``. Without a radius it follows from the threshold (``radius_for``): three standard deviations
    above what is expected at the threshold, so about one window in a thousand there is missed, and fewer above.

    Null ids and null or empty texts match nothing, nor do items or documents with fewer words than a shingle. Rows with the same
    id are one document (or item), whatever their texts; their best window counts. Other columns are ignored, whatever their names. An empty table on either side gives no rows. Texts of any length are read whole. Items are held by
    every task, so more than ``max_items`` are an error.
    """
    radius = radius_for(threshold) if radius is None else radius
    if not 0 <= radius < BITS:
        raise ValueError(f"radius must be from 0 to {BITS - 1}")
    lean(docs.sparkSession)
    rows = small(benchmark.select(F.col(item_id_col).cast("long"), F.lower(F.col(item_text_col).cast("string"))), max_items, "benchmark")
    items = prepare([tuple(r) for r in rows], shingle_words, radius, threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = docs.mapInArrow(_scan(items), "doc_id long, item_id long, start_word int, n_words int, similarity double")
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("similarity"), "start_word", "n_words").alias("x")).alias("x"))
    return best.select("doc_id", "item_id", "x.start_word", "x.n_words", (-F.col("x.col1")).alias("similarity"))


def _scan(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text"):
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for text, item, start, end, j in matches(words, items):
                new = (-j, start - int(words.offsets[text]), end - start)
                if new < best.get((text, item), (1.0, 0, 0)):
                    best[text, item] = new
            if best:
                ids = ints(batch, "doc_id")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[t]) for t, _ in best]), pa.array([items.ids[i] for _, i in best], pa.int64()), pa.array([x[1] for x in best.values()], pa.int32()), pa.array([x[2] for x in best.values()], pa.int32()), pa.array([-x[0] for x in best.values()])],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item (see contamination), with all their columns as they are.

    Rows without an id stay, as do null and empty texts. If one of several rows with an id matches, all of them go. Repeated rows
    stay repeated. Other columns may have any names. An empty table gives none; an empty benchmark keeps all.
    """
    return without(docs, contamination(docs, benchmark, id_col=id_col, **options).select("doc_id"), id_col)
