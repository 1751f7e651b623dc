"""Substring dedup by suffix arrays, built by induced sorting.

The words of a shard are one text, in which every window ends with a separator of its own. The suffix array of that text is
made by induced sorting: classify suffixes, sort the leftmost-smaller (LMS) substrings, recurse on their names, and induce
the rest in two linear scans. The permuted common prefixes (PLCP, by the phi of each suffix) then give the prefix that each
suffix shares with the one before it in the array. Suffixes in a row that share at least min_words words are one repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import SHARD_WORDS, repeated_spans


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last one, the sentinel, is S."""
    n = len(s)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    if n == 1:
        return smaller
    step = s[:-1].astype(np.int64) - s[1:]
    differs = np.append(step != 0, True)
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # from each place the first one that differs from its successor
    smaller[:-1] = np.append(step < 0, True)[nxt[:-1]]
    return smaller


def _induce(s: list[int], s_type: list[bool], counts: np.ndarray, lms: np.ndarray) -> list[int]:
    """The suffix array in which the suffixes `lms`, in this order at their buckets' ends, put all others in their place."""
    n = len(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    symbol = np.asarray(s)[lms]
    # the last ones of each bucket, in order: a place is the bucket's end less how many of it follow
    order = np.argsort(symbol, kind="stable")
    lms, symbol = lms[order], symbol[order]
    size = np.bincount(symbol, minlength=len(counts))
    rank = np.arange(len(lms)) - (np.cumsum(size) - size)[symbol]
    sa[ends[symbol] - size[symbol] + rank] = lms
    out = sa.tolist()
    head = starts.tolist()
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not s_type[j]:
            c = s[j]
            out[head[c]] = j
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and s_type[j]:
            c = s[j]
            out[tail[c]] = j
            tail[c] -= 1
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of integers from 0 on, the last of which is the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    counts = np.bincount(s)
    s_type = classify(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    symbols, types = s.tolist(), s_type.tolist()
    first = np.array(_induce(symbols, types, counts, lms))
    in_order = first[is_lms[first]]  # LMS substrings, sorted
    # names: an LMS substring reaches to the next LMS place; neighbours with the same words have the same name
    length = np.diff(np.append(lms, n - 1)) + 1
    length_at = np.zeros(n, np.int64)
    length_at[lms] = length
    a, b = in_order[:-1], in_order[1:]
    same = length_at[a] == length_at[b]
    check = np.flatnonzero(same)
    offset = 0
    while len(check):
        going = length_at[a[check]] > offset
        check = check[going]
        equal = s[a[check] + offset] == s[b[check] + offset]
        same[check[~equal]] = False
        check = check[equal]
        offset += 1
    name = np.zeros(n, np.int64)
    name[in_order] = np.concatenate([[0], np.cumsum(~same)])
    names = name[lms]
    if names.max() + 1 < len(lms):
        ordered = lms[suffix_array(names)]
    else:
        ordered = np.empty_like(lms)
        ordered[names] = lms
    return np.array(_induce(symbols, types, counts, ordered))


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the text, how many words its suffix shares with the one before it in the array."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    text, before, out = s.tolist(), phi.tolist(), [0] * n
    shared = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            shared = 0
            continue
        while i + shared < n and j + shared < n and text[i + shared] == text[j + shared]:
            shared += 1
        out[i] = shared
        if shared:
            shared -= 1
    return np.array(out)


def shard_text(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows as one text of ranks, and where each window begins. Each window ends with a separator of its own; the last one is 0."""
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    m = len(texts)
    _, rank = np.unique(np.concatenate(texts), return_inverse=True)
    s = np.empty(int(lengths.sum()) + m, np.int64)
    is_word = np.ones(len(s), bool)
    is_word[starts + lengths] = False
    s[is_word] = rank + m
    s[~is_word] = np.arange(m - 1, -1, -1)
    return s, starts


def intervals(window: np.ndarray, run: np.ndarray, occurrences: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs in a row of a window as one interval, with the most occurrences among them."""
    if not len(window):
        return
    order = np.lexsort((run, window))
    window, run, occurrences = window[order], run[order], occurrences[order]
    new = np.append(True, (np.diff(window) != 0) | (np.diff(run) > 1))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(run)) - 1
    yield from zip(window[at].tolist(), run[at].tolist(), run[last].tolist(), np.maximum.reduceat(occurrences, at).tolist())


def covered_runs(group: np.ndarray, window: np.ndarray, run: np.ndarray, n: np.ndarray, first_doc: np.ndarray, last_doc: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group: for sorted runs, the number of the set of equal ones. Window, run and occurrences of those with two documents, or (within) two places."""
    if not len(group):
        return window, run, run
    at = np.flatnonzero(np.append(True, np.diff(group) != 0))
    times = np.add.reduceat(n[window], at)
    two = times > 1 if within else np.minimum.reduceat(first_doc[window], at) != np.maximum.reduceat(last_doc[window], at)
    size = np.diff(np.append(at, len(group)))
    keep = np.repeat(two, size)
    return window[keep], run[keep], np.repeat(times, size)[keep]


def kernel(texts: list[np.ndarray], runs: np.ndarray, n: np.ndarray, first_doc: np.ndarray, last_doc: np.ndarray, min_words: int, within: bool = False) -> Iterator[tuple[int, int, int, int]]:
    s, starts = shard_text(texts)
    sa = suffix_array(s)
    shared = permuted_common_prefixes(s, sa)[sa]
    window = np.searchsorted(starts, sa, side="right") - 1
    run = sa - starts[window]
    is_run = run < runs[window]  # a run has min_words words before the separator; no other suffix shares so many with any
    group = np.cumsum(shared < min_words)[is_run]
    yield from intervals(*covered_runs(group, window[is_run], run[is_run], n, first_doc, last_doc, within))


def suffix_array_dedup(docs: DataFrame, min_words: int = 50, text_col: str = "text", id_col: str = "doc_id", shard_words: int = SHARD_WORDS, within: bool = False) -> DataFrame:
    """Spans of text that repeat across documents: doc_id, start_word, end_word (exclusive), n_words, occurrences.

    A span is maximal: each of its words is in a run of ``min_words`` words (split at ASCII blanks) that some document with another
    id has too. ``occurrences`` is how often the commonest such run occurs in all. With ``within``, a run that occurs at two
    places of one document counts as well, and ``occurrences`` is the number of places.

    Null ids and null texts give nothing, as do texts with fewer than ``min_words`` words. Rows with the same id are one
    document, whatever their texts: a repeated row by itself is no repeat, and each of several texts is searched. Words are compared by 64-bit
    hashes. Other columns are ignored, whatever their names. An empty table gives no rows. Texts of any length are read whole.
    """
    return repeated_spans(docs, kernel, min_words, text_col, id_col, shard_words, within)
