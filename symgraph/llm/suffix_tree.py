"""Substring dedup by suffix trees over prefix partitions.

The suffixes of a shard are split by variable-length prefixes: a prefix with too many suffixes for memory is made longer by a
word at a time, until each group is small. A group's suffixes are put in order in elastic ranges: the next words of all
suffixes that are not yet apart from their neighbours are read and sorted, and where two neighbours part is the depth of
their branch. Leaves and branch depths are the subtree; its internal nodes of at least min_words words are repeats, and
what they cover of a document, joined, is a maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import SHARD_WORDS, repeated_spans
from .suffix_array import covered_runs, intervals, shard_text

#: suffixes that a subtree is made of at once, and words read of each in a range
GROUP, RANGE = 50_000, 6


def prefix_groups(s: np.ndarray, suffixes: np.ndarray, deepest: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes that share a prefix, and its length. A group is within `most`, or shares `deepest` words, so that no deep node is cut."""
    todo = [(suffixes, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= most or depth >= deepest:
            yield group, depth
            continue
        reach = group + depth
        symbol = np.where(reach < len(s), s[np.minimum(reach, len(s) - 1)], -1)
        order = np.argsort(symbol, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(symbol[order]) != 0))
        todo += [(p, depth + 1) for p in np.split(group[order], at[1:])[::-1]]


def virtual_trees(groups: Iterator[tuple[np.ndarray, int]], most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Small groups side by side, up to `most` suffixes: suffixes, and the number and prefix length of each one's group."""
    have: list[tuple[np.ndarray, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(g) for g, _ in have]
        return np.concatenate([g for g, _ in have]), np.repeat(np.arange(len(have)), sizes), np.repeat([d for _, d in have], sizes)

    for group, depth in groups:
        if have and size + len(group) > most:
            yield joined()
            have, size = [], 0
        have.append((group, depth))
        size += len(group)
    if have:
        yield joined()


def leaves_and_branches(s: np.ndarray, suffixes: np.ndarray, group: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order within their groups, and for each the words that it shares with the one before it (0 for a group's first)."""
    m = len(suffixes)
    leaves, depth, branch = suffixes.copy(), depth.astype(np.int64), np.zeros(m, np.int64)
    area = np.searchsorted(group, group)  # suffixes that are alike so far, by the place of the first
    bits = int(s.max(initial=0) + 2).bit_length()
    each = max(1, 63 // bits)  # words packed in a number
    active = np.arange(m)
    while len(active):
        at = leaves[active] + depth[active]
        words = [np.where(at + c < len(s), s[np.minimum(at + c, len(s) - 1)] + 1, 0) for c in range(RANGE)]
        keys = []
        for lo in range(0, RANGE, each):
            k = np.zeros(len(active), np.int64)
            for w in words[lo : lo + each]:
                k = (k << bits) | w
            keys.append(k)
        order = np.lexsort((*keys[::-1], area[active]))
        leaves[active] = leaves[active][order]  # areas are contiguous, so places stay within their area
        together = np.append(False, area[active][1:] == area[active][:-1])
        first = np.full(len(active), RANGE)
        for c in range(RANGE - 1, -1, -1):
            w = words[c][order]
            first[1:][w[1:] != w[:-1]] = c
        parts = together & (first < RANGE)
        branch[active[parts]] = depth[active[parts]] + first[parts]
        fresh = ~together | parts
        area[active] = active[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        stay = together & ~parts
        stay[:-1] |= stay[1:]
        depth[active] += RANGE
        active = active[stay]
    return leaves, branch


def deep_nodes(branch: np.ndarray, min_words: int) -> np.ndarray:
    """For each leaf the number of the highest internal node of at least min_words words above it, or one of its own.

    A subtree's internal nodes are the stretches of leaves between shallower branches. Those of at least min_words words are nested in
    the highest one, whose leaves all share min_words words, so nodes below it cover nothing more.
    """
    return np.cumsum(branch < min_words)


def kernel(texts: list[np.ndarray], runs: np.ndarray, n: np.ndarray, first_doc: np.ndarray, last_doc: np.ndarray, min_words: int, within: bool = False) -> Iterator[tuple[int, int, int, int]]:
    s, starts = shard_text(texts)
    size = runs.astype(np.int64)
    begin = np.cumsum(size) - size
    suffixes = np.repeat(starts - begin, size) + np.arange(size.sum())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tree in virtual_trees(prefix_groups(s, suffixes, min_words)):
        leaves, branch = leaves_and_branches(s, *tree)
        window = np.searchsorted(starts, leaves, side="right") - 1
        found.append(covered_runs(deep_nodes(branch, min_words), window, leaves - starts[window], n, first_doc, last_doc, within))
    if found:
        yield from intervals(*(np.concatenate(x) for x in zip(*found)))


def suffix_tree_dedup(docs: DataFrame, min_words: int = 50, text_col: str = "text", id_col: str = "doc_id", shard_words: int = SHARD_WORDS, within: bool = False) -> DataFrame:
    """Maximal repeats of all documents: doc_id, start_word, end_word (exclusive), n_words, occurrences.

    A row is a maximal stretch of a document that internal nodes of at least ``min_words`` words cover, with leaves of two
    documents under each of them; ``occurrences`` is the most leaves (with copies) under one of them. With ``within``, two leaves of one
    document are enough, and copies of a row are one.

    Null ids and null texts give nothing, as do texts with fewer than ``min_words`` words. Rows with the same id are one
    document, whatever their texts: a repeated row by itself is no repeat, and each of several texts is searched. Words are compared by 64-bit
    hashes. Other columns are ignored, whatever their names. An empty table gives no rows. Texts of any length are read whole.
    """
    return repeated_spans(docs, kernel, min_words, text_col, id_col, shard_words, within)
