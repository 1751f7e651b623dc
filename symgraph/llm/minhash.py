"""Near-duplicate documents: MinHash bands propose pairs, sequential Bayesian verification prunes them, exact Jaccard decides.

Documents with the same words are one from the start. In each bucket of equal bands every document is compared with the
bucket's least id (a star, so a bucket of n costs n comparisons). A document that turns out not to be similar to it is then
compared with all others of the bucket that no chain of similar documents connects it with yet; two documents that both
passed are connected already. These comparisons are made between blocks of short signatures, a row for each document and
block, and only pairs that the posterior doesn't drop become rows. So groups are those that comparing all pairs of each bucket would give, at any bucket size,
without a cap.

A comparison reads the two signatures a batch of hashes at a time. With m of n hashes equal so far and a uniform prior, the
similarity has the posterior Beta(m + 1, n - m + 1); where the chance that it reaches the threshold is below ``miss``, the pair is
dropped. Pairs that survive all batches are verified exactly on their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import lean, narrowed, written
from .textblock import U, Words, blocks, grams, ints, mix, signed, spans, split

BANDS, ROWS, BATCH = 36, 4, 16
#: bytes of text that a verification task takes at once, and that a group may have before it is salted
SHARD_BYTES, SALT_BYTES = 4 << 20, 2 << 20
#: hashes of a short signature (a byte of each), documents of a block, rows of a task and pairs that are compared at a time
SHORT, BLOCK, SHARD_ROWS, PAIRS = 64, 1024, 50_000, 1 << 20


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows of `size` words and where each text's begin; a shorter text has one, of all its words."""
    texts = words.texts()
    full = np.flatnonzero(words.room(size))
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    value = np.concatenate([grams(words.hashes, size)[full] if len(full) else np.zeros(0, U), spans(words.hashes, words.offsets[short], words.offsets[short + 1])])
    text = np.concatenate([texts[full], short])
    order = np.argsort(text, kind="stable")
    return value[order], np.searchsorted(text[order], np.arange(len(words.offsets)))


def signatures(values: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """The hashes first..last-1 of the signatures of texts that all have shingles: texts x hashes."""
    seeds = mix(np.arange(1, 2 * last + 1, dtype=U))
    out = np.empty((len(offsets) - 1, last - first), np.uint32)
    low, high = values.astype(np.uint32), (values >> U(32)).astype(np.uint32)
    for j in range(first, last):
        x = low * np.uint32(seeds[2 * j] | U(1))
        x ^= high
        x *= np.uint32((seeds[2 * j + 1] & U(0xFFFFFFFF)) | U(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[:, j - first] = np.minimum.reduceat(x, offsets[:-1])
    return out


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text", 1 << 20):
            values, offsets = shingles(words, size)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            signature = signatures(values, np.append(offsets[some], len(values)), 0, BANDS * ROWS)
            short = np.ascontiguousarray(signature[:, :SHORT].astype(np.uint8))
            short = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, short.size + 1, SHORT, dtype=np.int32)), pa.py_buffer(short)])
            signature = signature.astype(U)
            band = np.zeros((len(some), BANDS), U)
            for r in range(ROWS):
                band = mix(band ^ signature[:, r::ROWS]) + U(r)
            band += np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)
            same = spans(words.hashes, words.offsets[some], words.offsets[some + 1])
            begin = np.append(words.starts, len(words.data))[words.offsets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ints(batch, "doc_id")[some]), signed(same), pa.array(np.diff(begin)[some]), short, pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * BANDS + 1, BANDS, dtype=np.int32)), signed(mix(band).ravel()))],
                ["doc_id", "same", "n_bytes", "short", "bands"],
            )

    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch, the least number of equal hashes with which the posterior chance of reaching the threshold is at least `miss`."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[x >= threshold].sum() / density.sum() >= miss:
                out.append(m)
                break
    return out


def similar(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """The exact Jaccard similarity of the pairs of texts a, b; 0 for those that the posterior drops."""
    out = np.zeros(len(a))
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    sizes = np.diff(offsets)
    for i, enough in enumerate(least):
        if not len(alive):
            return out
        used = np.unique(np.concatenate([a[alive], b[alive]]))
        if len(used) == len(sizes):
            part, at = values, offsets
        else:
            part = np.concatenate([values[offsets[t] : offsets[t + 1]] for t in used])
            at = np.append(0, np.cumsum(sizes[used]))
        signature = signatures(part, at, i * BATCH, (i + 1) * BATCH)
        ia, ib = np.searchsorted(used, a[alive]), np.searchsorted(used, b[alive])
        matches[alive] += (signature[ia] == signature[ib]).sum(1)
        alive = alive[matches[alive] >= enough]
    sets: dict[int, np.ndarray] = {}
    for t in np.unique(np.concatenate([a[alive], b[alive]])) if len(alive) else ():
        sets[t] = np.unique(values[offsets[t] : offsets[t + 1]])
    for p in alive:
        x, y = sets[a[p]], sets[b[p]]
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        out[p] = shared / (len(both) - shared)
    return out


def _verify(size: int, threshold: float, miss: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    least = least_matches(threshold, miss)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["a", "salt", "doc_id", "same"])
        values, offsets = shingles(split(pa.array(rows["text"], pa.large_string())), size)
        group = rows.groupby(["a", "salt"]).ngroup().to_numpy()
        is_a = (rows["doc_id"] == rows["a"]).to_numpy()
        at = np.full(group.max() + 1, -1)
        at[group[is_a]] = np.flatnonzero(is_a)
        member = np.flatnonzero(~is_a & (at[group] >= 0))
        jaccard = similar(values, offsets, at[group[member]], member, threshold, least)
        ids = rows["doc_id"].to_numpy()
        return pd.DataFrame({"a": ids[at[group[member]]], "b": ids[member], "jaccard": jaccard}).astype({"a": "int64", "b": "int64"})

    return run


def verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, size: int, threshold: float, miss: float) -> DataFrame:
    """a, b, jaccard of all pairs a, b; 0 where the pair was pruned. Each a's text meets its b's, a large group in several parts."""
    bytes_of = sketches.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    members = pairs.join(bytes_of.withColumnRenamed("doc_id", "b"), "b")
    parts = members.groupBy("a").agg(F.ceil(F.sum("n_bytes") / SALT_BYTES).cast("int").alias("parts"))
    rows = members.join(parts, "a").select("a", F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "n_bytes")
    heads = parts.join(bytes_of.withColumnRenamed("doc_id", "a"), "a").select("a", F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "n_bytes")
    wanted = written(rows.unionByName(heads), "pair-texts")
    total = wanted.agg(F.sum("n_bytes")).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_BYTES))
    docs = narrowed(docs, wanted, "doc_id")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt")).alias("in"))
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("same"), F.explode("in").alias("in")).select("doc_id", "text", "same", "in.a", "in.salt")
    return texts.groupBy(F.pmod(F.xxhash64("a", "salt"), F.lit(n_shards)).alias("shard")).applyInPandas(_verify(size, threshold, miss), "a long, b long, jaccard double")


def _close(threshold: float, miss: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of blocks of buckets: the pairs, one of them odd, that nothing connects yet and whose short signatures leave them a chance. Equal bytes of unequal hashes only make that lenient."""
    least = least_matches(threshold, miss)[: SHORT // BATCH]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(["band", "i", "j"]).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        group = group[order]
        short = np.frombuffer(b"".join(rows["short"]), np.uint8).reshape(-1, SHORT)[order]
        ids, label, block, odd = (rows[c].to_numpy()[order] for c in ("b", "label", "block", "odd"))
        inner = (rows["i"] == rows["j"]).to_numpy()[order]
        at = np.searchsorted(group, group)
        n = np.searchsorted(group, group, side="right") - at
        heads = np.flatnonzero(odd)
        total = np.cumsum(n[heads])
        found = [np.zeros((0, 2), np.int64)]
        lo = 0
        while lo < len(heads):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
            x, size = heads[lo:hi], n[heads[lo:hi]]
            y = np.repeat(at[x] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x = np.repeat(x, size)
            ok = np.flatnonzero((label[x] != label[y]) & (inner[x] | (block[x] != block[y])) & ~(odd[y] & (ids[y] <= ids[x])))
            x, y = x[ok], y[ok]
            matches = np.zeros(len(x), np.int64)
            for k, enough in enumerate(least):
                matches += (short[x, k * BATCH : (k + 1) * BATCH] == short[y, k * BATCH : (k + 1) * BATCH]).sum(1)
                alive = np.flatnonzero(matches >= enough)
                x, y, matches = x[alive], y[alive], matches[alive]
            found.append(np.sort(np.stack([ids[x], ids[y]], 1), axis=1))
            lo = hi
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return run


def _close_pairs(buckets: DataFrame, odd: DataFrame, sketches: DataFrame, labels: DataFrame, threshold: float, miss: float) -> DataFrame:
    """a, b of each odd (band, b) and each other member of its bucket, as far as they may be similar and nothing connects them."""
    members = buckets.where("a <> b").select("band", "b").join(odd.select("band", "b", F.lit(True).alias("odd")).distinct(), ["band", "b"], "left")
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("odd").alias("any")).where("any").drop("any")
    members = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    members = members.join(labels.select(F.col("id").alias("b"), "label"), "b", "left").join(sketches.select(F.col("doc_id").alias("b"), "short").distinct(), "b")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = members.select("band", "b", F.coalesce("odd", F.lit(False)).alias("odd"), F.coalesce("label", "b").alias("label"), "short", "block", other)
    tiles = written(tiles.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "b", "odd", "label", "short", "block"), "tiles")
    n_shards = max(1, -(-tiles.count() // SHARD_ROWS))
    return tiles.groupBy(F.pmod(F.xxhash64("band", "i", "j"), F.lit(n_shards)).alias("shard")).applyInPandas(_close(threshold, miss), "a long, b long")


def minhash_near_dedup(docs: DataFrame, threshold: float = 0.5, shingle_words: int = 3, miss: float = 0.001, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of near-duplicate documents: doc_id, group_id (the least id of the group), for groups of two or more.

    Two documents are near duplicates if the Jaccard similarity of their sets of ``shingle_words``-word shingles (lower case,
    split at ASCII blanks) is at least ``threshold``; groups are the connected components. A pair at the threshold shares a band
    with probability 0.9, one at 0.6 with 0.99; a similar pair is pruned with a posterior chance below ``miss``.

    Null ids, null texts and texts without a word are in no group. A text of fewer words than a shingle has one shingle, of all
    its words. Rows with the same id are one document. Other columns are ignored, whatever their names. An empty table gives
    no rows. Texts of any length are compared whole.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sketches = written(docs.mapInArrow(_sketch(shingle_words), "doc_id long, same long, n_bytes long, short binary, bands array<long>"), "sketches")
    heads = sketches.groupBy("same").agg(F.min("doc_id").alias("head"))
    copies = sketches.join(heads, "same").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    distinct = sketches.join(heads, "same").where("doc_id = head").select("doc_id", F.explode("bands").alias("band"))
    of_band = Window.partitionBy("band")
    buckets = distinct.withColumn("a", F.min("doc_id").over(of_band)).withColumn("last", F.max("doc_id").over(of_band)).where("a <> last")
    buckets = written(buckets.select("band", "a", F.col("doc_id").alias("b")), "buckets")
    stars = written(verified(docs, sketches, buckets.where("a <> b").select("a", "b").distinct(), shingle_words, threshold, miss), "stars")
    labels = components(copies.union(stars.where(F.col("jaccard") >= threshold).select("a", "b")))
    failed = stars.groupBy("a", "b").agg(F.max("jaccard").alias("j")).where(F.col("j") < threshold).select("a", "b")
    odd = buckets.join(failed, ["a", "b"]).select("band", "b")
    rest = _close_pairs(buckets, odd, sketches, labels, threshold, miss)
    rest = written(rest.distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verified(docs, sketches, rest, shingle_words, threshold, miss).where(F.col("jaccard") >= threshold).select("a", "b")
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more))
    return labels.select(F.col("id").alias("doc_id"), F.col("label").alias("group_id"))
