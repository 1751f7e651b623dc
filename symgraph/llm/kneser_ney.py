"""Perplexity by an interpolated modified Kneser-Ney trigram model, counted by Spark and memory-mapped by the workers.

Words are counted first: their sorted 64-bit hashes are files by hash range, and each word gets a number, frequent ones small numbers.
Counting n-grams is one shuffle of packed, sorted arrays of trigrams (a, b, c) by the middle word b. Both bigrams of a trigram contain
b, so the followers of (a, b) and the continuation count of (b, c), the number of different a, are complete within a bucket. Middle
words that are a large share of a bucket are spread over all buckets by a, and their bigrams' continuation counts added up by (b, c).

Each bucket is written where it is counted, without another shuffle: the sorted hashes of its contexts, and for each context its
followers, in order, with their counts. Most contexts have one follower; these are apart, with no more than that. A context is two numbers in 64 bits and its hash a permutation of these, so no two of them collide.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, lean, local_path, new_path, written
from .textblock import U, Words, blocks, mix

PAD, BOS, EOS, UNKNOWN = U(0), U(1), U(2), U(0xFFFFFFFF)
LOW = U(0xFFFFFFFF)
#: trigrams, or different words, gathered before they are packed; text bytes of a bucket and of a file of words; numbers of words in a file of unigrams or sums
FLUSH, BUCKET_BYTES, WORD_BYTES, UNIGRAMS, SUMS = 1_000_000, 16 << 20, 64 << 20, 1 << 20, 1 << 10
#: occurrences from which on (to the power of two below) a word is spread over all buckets
HOT = 1 << 18
#: files that a worker maps at once
OPEN = 8192
_TYPES = (np.uint64, np.int64, np.uint32, np.uint8)


# files of arrays


def save(path: str, arrays: list[np.ndarray]) -> None:
    """A task that runs again writes the same under another name first."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        out.write(np.array([len(arrays), *(x for a in arrays for x in (_TYPES.index(a.dtype.type), len(a)))], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    os.replace(temporary, path)


def mapped(path: str) -> list[np.ndarray]:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int(raw[:8].view(np.int64)[0])
    at, out = 8 + 16 * n, []
    for code, length in raw[8:at].view(np.int64).reshape(-1, 2).tolist():
        size = length * np.dtype(_TYPES[code]).itemsize
        out.append(raw[at : at + size].view(_TYPES[code]))
        at += size + (-size % 8)
    return out


class Files:
    """The model's files, mapped when they are asked for. It has no data, so it can be sent to any worker."""

    folder: str

    def file(self, kind: str, number: int) -> list[np.ndarray] | None:
        have = self.__dict__.setdefault("_open", {})
        if (kind, number) not in have:
            if len(have) >= OPEN:
                have.clear()
            path = f"{self.folder}/{kind}-{number:07d}"
            have[kind, number] = mapped(path) if os.path.exists(path) else None
        return have[kind, number]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}


def stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where equal numbers are in a row."""
    if len(x):
        at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        yield from zip(at.tolist(), np.append(at[1:], len(x)).tolist())


def firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = firsts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


# words


@dataclass
class Vocabulary(Files):
    folder: str
    bits: int
    words: int
    hot: int  # numbers below belong to words that are spread

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, UNKNOWN for those that weren't counted."""
        word, of_word = np.unique(hashes, return_inverse=True)
        out = np.full(len(word), UNKNOWN, U)
        file = _file(word, self.bits)
        for i, j in stretches(file):
            if (arrays := self.file("words", int(file[i]))) is not None:
                known, rank, level = arrays
                base = self.file("base", 0)[0].reshape(-1, 64)[int(file[i])]
                at = np.minimum(np.searchsorted(known, word[i:j]), len(known) - 1)
                hit = np.flatnonzero(known[at] == word[i:j])
                out[i + hit] = base[level[at[hit]]].astype(U) + rank[at[hit]]
        return out[of_word]


def _file(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _count_words(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        z, file = zstandard.ZstdCompressor(level=1), _file(word, bits)
        out = [(int(file[i]), z.compress(word[i:j].tobytes() + n[i:j].astype(U).view(np.uint8).reshape(-1, 8).T.tobytes())) for i, j in stretches(file)]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["file", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, words in blocks(batches, "text"):
            parts.append(np.unique(words.hashes, return_counts=True))
            size += len(parts[-1][0])
            if size >= FLUSH:
                parts = [summed(*(np.concatenate(x) for x in zip(*parts)))]
                size = len(parts[0][0])
                if size >= FLUSH // 2:
                    yield rows(*parts[0])
                    parts, size = [], 0
        if size:
            yield rows(*summed(*(np.concatenate(x) for x in zip(*parts))))

    return run


def _number(folder: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One file of words: hashes, rank among those of the file that are about as frequent, and how frequent (0: most) by powers of two."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8).reshape(2, -1) for p in rows["payload"]]
        word, n = summed(np.concatenate([x[0].view(U) for x in raw]), np.concatenate([np.ascontiguousarray(x[1].reshape(8, -1).T).view(U).ravel() for x in raw]))
        level = 64 - np.frexp(n.astype(np.float64))[1]
        size = np.bincount(level, minlength=64)
        rank = np.empty(len(word), np.uint32)
        rank[np.argsort(level, kind="stable")] = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        file = int(rows["file"].iloc[0])
        save(f"{folder}/words-{file:07d}", [word, rank, level.astype(np.uint8)])
        return pd.DataFrame([(file, size.tolist(), np.bincount(level, n.astype(float), 64).astype(np.int64).tolist())], columns=["file", "words", "tokens"])

    return run


def vocabulary(docs: DataFrame, n_bytes: int, folder: str) -> tuple[Vocabulary, int]:
    """The words of all documents, numbered, and how many occurrences those that are spread have."""
    bits = max(0, int(np.ceil(np.log2(max(1, n_bytes / WORD_BYTES)))))
    packed = docs.mapInArrow(_count_words(bits), "file long, payload binary")
    files = packed.groupBy("file").applyInPandas(_number(folder), "file long, words array<long>, tokens array<long>").collect()  # one for each file
    size, tokens = np.zeros((1 << bits, 64), np.int64), np.zeros(64, np.int64)
    for r in files:
        size[r.file] = r.words
        tokens += np.array(r.tokens, np.int64)
    total = int(size.sum())
    if total >= int(UNKNOWN) - 3:
        raise ValueError(f"{total} different words; numbers of words have 32 bits")
    before = np.cumsum(size.T.ravel()) - size.T.ravel()
    save(f"{folder}/base-{0:07d}", [np.ascontiguousarray(before.reshape(64, -1).T + 3).ravel().astype(np.int64)])
    level = 64 - HOT.bit_length()
    return Vocabulary(folder, bits, total, 3 + int(size[:, : level + 1].sum())), int(tokens[: level + 1].sum())


# trigrams


def padded(words: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' numbers, text by text, two marks before each text and one after; the texts that have words; where each begins, and the end of all."""
    texts = np.flatnonzero(words.counts)
    n = words.counts[texts]
    at = np.append(0, np.cumsum(n + 3))
    out = np.full(at[-1], EOS, U)
    out[at[:-1]], out[at[:-1] + 1] = PAD, BOS
    out[np.arange(len(numbers)) + np.repeat(3 * np.arange(len(texts)) + 2, n)] = numbers
    return out, texts, at


def trigrams(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, c of each word and end mark, and its place among all of the block."""
    last = np.ones(len(x), bool)
    last[at[:-1]] = last[at[:-1] + 1] = False
    i = np.flatnonzero(last)
    return x[i - 2], x[i - 1], x[i], i


def pair(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b << U(32)) | c


def counted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different trigrams in the order of b, a, c with their summed counts."""
    context = pair(b, a)
    order = np.argsort(context)
    rank = np.zeros(len(order), U)
    if len(order):
        rank[1:] = np.cumsum(context[order][1:] != context[order][:-1])
    order = order[np.argsort((rank << U(32)) | c[order])]
    a, b, c, n = a[order], b[order], c[order], n[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], c[at], np.add.reduceat(n, at) if len(at) else n


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted trigrams as differences, split into planes of bytes, of which most are zeros."""
    db = np.diff(b, prepend=U(0))
    same = np.append(False, db[1:] == 0)
    da = np.where(same, a - np.append(U(0), a[:-1]), a)
    planes = [x.astype(U).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (db, da, c, n)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(4, 8, -1)
    db, da, c, n = (np.ascontiguousarray(x.T).view(U).ravel() for x in raw)
    first = np.flatnonzero(np.append(True, db[1:] != 0))
    total = np.cumsum(da)
    a = total - np.repeat(total[first] - da[first], np.diff(np.append(first, len(da))))
    return a, np.cumsum(db), c, n


def bucket(a: np.ndarray, b: np.ndarray, hot: int, n_buckets: int) -> np.ndarray:
    return (mix(b + np.where(b < U(hot), (mix(a) | U(1)) * U(0x9E3779B97F4A7C15), U(0))) % U(n_buckets)).astype(np.int32)


def _map(known: Vocabulary, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, c = (np.concatenate(x) for x in zip(*parts))
        a, b, c, n = counted(a, b, c, np.ones(len(a), U))
        of = bucket(a, b, known.hot, n_buckets)
        order = np.argsort(of, kind="stable")
        rows = [order[i:j] for i, j in stretches(of[order])]
        return pa.RecordBatch.from_arrays([pa.array(of[[r[0] for r in rows]], pa.int32()), pa.array([pack(a[r], b[r], c[r], n[r]) for r in rows], pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, words in blocks(batches, "text"):
            x, _, at = padded(words, known.numbers(words.hashes))
            if len(x):
                parts.append(trigrams(x, at)[:3])
                size += len(parts[-1][0])
            if size >= FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


# contexts and their followers


def narrow(x: np.ndarray) -> list[np.ndarray]:
    """Bytes, 255 for what doesn't fit; the places and values of that."""
    big = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), big.astype(np.uint32), x[big].astype(np.int64)]


def widen(small: np.ndarray, big: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    escaped = np.flatnonzero(out == 255)
    if len(escaped):
        out[escaped] = values[np.searchsorted(big, at[escaped])]
    return out


def sums_of(at: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Of groups that begin at `at`: total; how many kept ones have count 1, 2, and 3 or more; and, where any are left out, the total kept."""
    kept = n >= least
    columns = [n, (n == 1) & kept, (n == 2) & kept, (n >= 3) & kept, *([n * kept] if least > 1 else [])]
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in columns], 1)


def contexts(context: np.ndarray, c: np.ndarray, n: np.ndarray, least: int) -> list[np.ndarray]:
    """A file's arrays of rows in the order of context and follower. Contexts with one follower: hashes, followers, counts. Others: hashes, where each one's kept followers begin, followers, counts, the contexts' sums."""
    first = firsts(context)
    size = np.diff(np.append(first, len(context)))
    keys = mix(context[first])
    order = np.argsort(keys)
    one = order[size[order] == 1]
    one = one[n[first[one]] >= least]
    out = [keys[one], c[first[one]].astype(np.uint32), *narrow(n[first[one]])]
    order = order[size[order] > 1]
    if not len(order):
        none = np.zeros(0, np.int64)
        return [*out, keys[order], np.zeros(1, np.uint32), none.astype(np.uint32), *narrow(none), *narrow(none)]
    sums = sums_of(first, n, least)[order]
    size = size[order]
    begin = np.cumsum(size) - size
    rows = np.repeat(first[order] - begin, size) + np.arange(size.sum())
    kept = n[rows] >= least
    starts = np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), begin)))
    return [*out, keys[order], starts.astype(np.uint32), c[rows][kept].astype(np.uint32), *narrow(n[rows][kept]), *narrow(sums.ravel())]


def within(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are in values[lo:hi], each of them sorted, and where: binary searches side by side, short and long stretches apart."""
    size, at = hi - lo, lo.copy()
    for least, most in ((1, 8), (9, np.iinfo(np.int64).max)):
        of = np.flatnonzero((size >= least) & (size <= most))
        if not len(of):
            continue
        base, left, x = lo[of], size[of], want[of]
        while left.max() > 1:
            half = left >> 1  # 0 where the search is over, so that what is read there doesn't matter
            base += half * (values[base + half - 1] < x)
            left -= half
        at[of] = base + (values[base] < x)
    some = np.flatnonzero(at < hi)
    some = some[values[at[some]] == want[some]]
    return some, at[some]


ROWS = "kind string, file long, payload binary, classes array<long>"
NONE = [0] * 5


def _row(kind: str, n: np.ndarray) -> tuple:
    return (kind, 0, b"", [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int(n.sum())])


def _unigrams(c: np.ndarray) -> list[tuple]:
    """How many different words each is after, here."""
    word, times = np.unique(c, return_counts=True)
    file = (word // U(UNIGRAMS)).astype(np.int64)
    return [("uni", int(file[i]), pack(np.zeros(j - i, U), word[i:j], word[i:j], times[i:j].astype(U)), NONE) for i, j in stretches(file)]


def _reduce(folder: str, hot: int, n_hot: int, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["bucket"].iloc[0])
        a, b, c, n = counted(*(np.concatenate(x) for x in zip(*map(unpack, rows["payload"]))))
        n = n.astype(np.int64)
        save(f"{folder}/tri-{number:07d}", contexts(pair(b, a), c, n, least))
        out = [_row("tri", n)]
        both = np.sort(pair(b, c))
        at = firsts(both)
        times = np.diff(np.append(at, len(both)))
        both = both[at]
        cut = int(np.searchsorted(both, U(hot) << U(32)))
        b, c, times, spread, spread_times = both[cut:] >> U(32), both[cut:] & LOW, times[cut:], both[:cut], times[:cut]
        if len(b):
            save(f"{folder}/bi-{number:07d}", contexts(b, c, times, least))
            out += [_row("bi", times), *_unigrams(c)]
        file = (mix(spread) % U(n_hot)).astype(np.int64)
        order = np.argsort(file, kind="stable")
        for i, j in stretches(file[order]):
            mine = order[i:j]
            out.append(("hot", int(file[mine[0]]), pack(np.zeros(j - i, U), spread[mine] >> U(32), spread[mine] & LOW, spread_times[mine].astype(U)), NONE))
        return pd.DataFrame(out, columns=["kind", "file", "payload", "classes"])

    return run


def _reduce_hot(folder: str, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Bigrams of spread words: their continuation counts, and the part of their contexts' sums that is here."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, b, c, n = (np.concatenate(x) for x in zip(*map(unpack, rows["payload"])))
        both, n = summed(pair(b, c), n.astype(np.int64))
        b, c = both >> U(32), both & LOW
        save(f"{folder}/hot-{int(rows['file'].iloc[0]):07d}", contexts(b, c, n, least))
        at = firsts(b)
        word, sums = b[at], sums_of(at, n, least)
        file = (word // U(SUMS)).astype(np.int64)
        z = zstandard.ZstdCompressor(level=1)
        out = [_row("bi", n), *_unigrams(c), *(("sums", int(file[i]), z.compress(word[i:j].tobytes() + sums[i:j].tobytes()), NONE) for i, j in stretches(file))]
        return pd.DataFrame(out, columns=["kind", "file", "payload", "classes"])

    return run


def _add_sums(folder: str, columns: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        file, out = int(rows["file"].iloc[0]), np.zeros((SUMS, columns), np.int64)
        for p in rows["payload"]:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.int64)
            n = len(raw) // (columns + 1)
            out[raw[:n] - file * SUMS] += raw[n:].reshape(n, columns)
        save(f"{folder}/sums-{file:07d}", [out.ravel()])
        return pd.DataFrame([(0, NONE)], columns=["words", "classes"])

    return run


def _add_unigrams(folder: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        file, out = int(rows["file"].iloc[0]), np.zeros(UNIGRAMS, np.int64)
        for p in rows["payload"]:
            _, word, _, n = unpack(p)
            out[word.astype(np.int64) - file * UNIGRAMS] += n.astype(np.int64)
        out = out[: int(np.flatnonzero(out)[-1]) + 1]
        save(f"{folder}/uni-{file:07d}", [out])
        return pd.DataFrame([(int((out > 0).sum()), _row("uni", out)[3])], columns=["words", "classes"])

    return run


def discounts(classes: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams have count 1, 2, 3, 4 (Chen and Goodman); a half, 1 and 1.5 where that isn't defined."""
    n1, n2, n3, n4 = classes[:4]
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return min(max(1 - 2 * y * n2 / n1, 0.0), 1.0), min(max(2 - 3 * y * n3 / n2, 0.0), 2.0), min(max(3 - 4 * y * n4 / n3, 0.0), 3.0)


@dataclass
class Model(Files):
    """Where the files are, the discounts of each order, and the unigrams' totals."""

    folder: str
    known: Vocabulary
    n_buckets: int
    n_hot: int
    columns: int
    d: dict[str, tuple[float, float, float]]
    words: int
    bigrams: int
    unigram_classes: tuple[int, int, int]

    def look(self, kind: str, level: str, file: np.ndarray, key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count of each follower of its context (0: none), the context's total (1) and the share of its mass that its kept followers leave (1).

        Look-ups are in the files' order, so that mapped pages are read in order.
        """
        order = np.argsort((file.astype(U) << U(40)) | (key >> U(24)))
        asked, key, c = file[order], key[order], c[order].astype(np.uint32)
        count, total, left = np.zeros(len(key), np.int64), np.ones(len(key)), np.ones(len(key))
        d = np.array([0.0, *self.d[level]])
        for i, j in stretches(asked):
            arrays = self.file(kind, int(asked[i]))
            if arrays is None:
                continue
            (known, follower, *counts), (keys, starts, followers, *many), of_sums = arrays[:5], arrays[5:11], arrays[11:]
            rest = np.arange(i, j)
            if len(known):
                at = np.minimum(np.searchsorted(known, key[i:j]), len(known) - 1)
                hit = known[at] == key[i:j]
                mine, at, rest = i + np.flatnonzero(hit), at[hit], i + np.flatnonzero(~hit)
                n = widen(*counts, at)
                total[mine], left[mine] = n, d[np.minimum(n, 3)] / n
                count[mine] = n * (follower[at] == c[mine])
            if len(keys) and len(rest):
                at = np.minimum(np.searchsorted(keys, key[rest]), len(keys) - 1)
                hit = keys[at] == key[rest]
                mine, at = rest[hit], at[hit]
                some, place = within(followers, starts[at].astype(np.int64), starts[at + 1].astype(np.int64), c[mine])
                count[mine[some]] = widen(*many, place)
                if kind != "hot":  # where the sums are in parts
                    sums = [widen(*of_sums, at * self.columns + k) for k in range(self.columns)]
                    total[mine], left[mine] = sums[0], self._left(level, *sums)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[back], total[back], left[back]

    def _dense(self, kind: str, number: np.ndarray, each: int, columns: int) -> np.ndarray:
        """Rows of arrays in which a word's number is the place."""
        out = np.zeros((len(number), columns), np.int64)
        file = (number // U(each)).astype(np.int64)
        order = np.argsort(file, kind="stable")
        for i, j in stretches(file[order]):
            arrays = self.file(kind, int(file[order[i]]))
            if arrays is not None:
                mine, rows = order[i:j], arrays[0].reshape(-1, columns)
                place = (number[mine] % U(each)).astype(np.int64)
                there = place < len(rows)
                out[mine[there]] = rows[place[there]]
        return out

    def _discounted(self, order: str, n: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.d[order]])
        return n - d[np.minimum(n, 3)]

    def _left(self, level: str, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, more: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """The share of contexts' mass that their kept followers leave."""
        d = self.d[level]
        given = (total if kept is None else kept) - n1 * d[0] - n2 * d[1] - more * d[2]
        return 1 - given / np.maximum(total, 1)

    def log_probability(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """ln p(c | a, b)."""
        n1, n2, more = self.unigram_classes
        d = self.d["uni"]
        given = (n1 * d[0] + n2 * d[1] + more * d[2]) / self.bigrams if self.bigrams else 1.0
        n = self._dense("uni", c, UNIGRAMS, 1)[:, 0]
        p = np.where(n > 0, self._discounted("uni", n) / max(self.bigrams, 1), 0) + given / (self.words + 1)
        n, total, left = np.zeros(len(b), np.int64), np.ones(len(b)), np.ones(len(b))
        hot = b < U(self.known.hot)
        cold, hot = np.flatnonzero(~hot), np.flatnonzero(hot)
        n[cold], total[cold], left[cold] = self.look("bi", "bi", bucket(b[cold], b[cold], self.known.hot, self.n_buckets), mix(b[cold]), c[cold])
        n[hot], _, _ = self.look("hot", "bi", (mix(pair(b[hot], c[hot])) % U(self.n_hot)).astype(np.int64), mix(b[hot]), c[hot])
        sums = self._dense("sums", b[hot], SUMS, self.columns).T
        total[hot], left[hot] = np.maximum(sums[0], 1), self._left("bi", *sums)
        left[hot[sums[0] == 0]] = 1
        p = np.where(n > 0, self._discounted("bi", n) / total, 0) + left * p
        n, total, left = self.look("tri", "tri", bucket(a, b, self.known.hot, self.n_buckets), mix(pair(b, a)), c)
        p = np.where(n > 0, self._discounted("tri", n) / total, 0) + left * p
        return np.log(p)


def train(docs: DataFrame, min_count: int = 1, text_col: str = "text") -> Model:
    """Count all documents. Trigrams, and bigrams by their continuation count, are kept from ``min_count`` on (1: all); all unigrams are.

    Counts of counts, totals and the mass that a context leaves to the shorter one are over all n-grams, kept or not.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    spark = docs.sparkSession
    lean(spark)
    docs = docs.select(F.lower(F.col(text_col).cast("string")).alias("text")).where("text IS NOT NULL")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4, -(-n_bytes // BUCKET_BYTES))
    folder = local_path(new_path(spark, "ngrams"))
    os.makedirs(folder)
    known, hot_tokens = vocabulary(docs, n_bytes, folder)
    n_hot = max(1, hot_tokens * 6 // BUCKET_BYTES)
    packed = docs.mapInArrow(_map(known, n_buckets), "bucket int, payload binary")
    first = written(packed.groupBy("bucket").applyInPandas(_reduce(folder, known.hot, n_hot, min_count), ROWS), "ngram-parts")
    second = written(first.where("kind = 'hot'").groupBy("file").applyInPandas(_reduce_hot(folder, min_count), ROWS), "hot-ngrams")
    parts, columns = first.where("kind <> 'hot'").unionByName(second), 4 + (min_count > 1)
    classes = {r.kind: list(r.c) for r in parts.where("kind IN ('tri', 'bi')").groupBy("kind").agg(F.array(*(F.sum(F.col("classes")[i]) for i in range(5))).alias("c")).collect()}
    schema = "words long, classes array<long>"
    parts.where("kind = 'sums'").groupBy("file").applyInPandas(_add_sums(folder, columns), schema).count()
    uni = parts.where("kind = 'uni'").groupBy("file").applyInPandas(_add_unigrams(folder), schema)
    uni = uni.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.array(*(F.coalesce(F.sum(F.col("classes")[i]), F.lit(0)) for i in range(5))).alias("classes")).first()
    drop(first)
    drop(second)
    n1, n2, _, _, bigrams = uni.classes
    d = {k: discounts(classes.get(k, NONE)) for k in ("tri", "bi")} | {"uni": discounts(list(uni.classes))}
    return Model(folder, known, n_buckets, n_hot, columns, d, uni.words, bigrams, (n1, n2, uni.words - n1 - n2))


def perplexity(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, log_prob (natural, a word, the end mark counted as one), total_log_prob, perplexity of each row; null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, "text", 1 << 22):
            x, texts, at = padded(words, model.known.numbers(words.hashes))
            total = np.full(batch.num_rows, np.nan)
            if len(x):
                a, b, c, i = trigrams(x, at)
                total[texts] = np.add.reduceat(model.log_probability(a, b, c), np.searchsorted(i, at[:-1]))
            none = np.isnan(total)
            mean = total / (words.counts + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(words.counts.astype(np.int64)), pa.array(mean, mask=none), pa.array(total, mask=none), pa.array(np.exp(-mean), mask=none)], ["doc_id", "n_words", "log_prob", "total_log_prob", "perplexity"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, log_prob double, total_log_prob double, perplexity double")


def lm_scores(docs: DataFrame, min_count: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The perplexity of every document by a trigram model of all of them: doc_id, n_words, log_prob (a word), total_log_prob, perplexity.

    One row for each input row, in whole texts (lower case, words split at ASCII blanks, compared by 64-bit hashes). Null or empty
    texts, and those without words, have null scores and add nothing to the counts; null ids stay null; repeated rows are counted and
    scored each. Texts of any length are read whole. Other columns are ignored, whatever their names. An empty table gives no rows. The shared
    folder (spark.checkpoint.dir) has to be mounted on all hosts, as the model's files are memory-mapped there. 2**32 different words or more are an error.
    """
    return perplexity(docs, train(docs, min_count, text_col), text_col, id_col)
