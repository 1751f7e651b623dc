"""Words of many texts at once, as arrays: hashes, places, and rolling hashes of word sequences.

A word is a maximal run of bytes above 0x20, so only ASCII blanks and control characters separate words. All arrays are
built by numpy over the UTF-8 bytes of an Arrow column; there is no Python loop over words or texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) <= n:
        have = np.empty(max(n + 1, 1 << 16), U)
        have[0] = 1
        filled = 1
        while filled < len(have):  # double what is there
            more = min(filled, len(have) - filled)
            have[filled : filled + more] = have[:more] * U(pow(base, filled, 1 << 64))
            filled += more
        _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts:ends] for each pair; equal contents give equal hashes wherever they lie."""
    up, down = powers(base, len(values)), powers(pow(base, -1, 1 << 64), len(values))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """hashes, starts and ends (bytes) of all words; offsets: where each text's words begin, and the end of all."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def room(self, k: int) -> np.ndarray:
        """Whether k words of one text begin at each place."""
        left = np.repeat(self.offsets[1:], self.counts) - np.arange(len(self.hashes))
        return left >= k


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split(column: pa.Array, chunk: int = 1 << 19) -> Words:
    data, at = buffers(column)
    word = np.zeros(len(data) + 1, bool)
    np.greater(data, 32, out=word[:-1])
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    ends = np.flatnonzero(before & (~word | first))
    hashes = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):  # whole words of about `chunk` bytes at a time bound the memory
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + chunk)))
        base = starts[lo]
        hashes[lo:hi] = _ranges(data[base : ends[hi - 1]].astype(U) + U(1), starts[lo:hi] - base, ends[lo:hi] - base, _P)
        lo = hi
    return Words(data, hashes, starts, ends, np.searchsorted(starts, at))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on, as if all were one text; see Words.room."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    return _ranges(hashes, np.arange(n), np.arange(k, k + n), _Q)


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the words from starts to ends, comparable with ``grams``."""
    return _ranges(hashes, starts, ends, _Q)


def sliding(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Whole rows of about `most` bytes of text at a time (a longer text is alone), with their words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo), split(column.slice(lo, hi - lo))
            lo = hi


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls, as an array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
