"""Vectors as array columns, hashes of words, and similarity of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def dot(a: Column, b: Column) -> Column:
    """In doubles; 0 for vectors of different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """A vector of about no length is left as it is. The length is bound by a lambda of its own, else it would be worked out again for each element."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(x.cast("double"))))
    return F.element_at(scaled, 1)


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over the word's characters, as a long."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a_words(words: list[str]) -> np.ndarray:
    """The same of many words at once: those of one length side by side, character by character."""
    out, lengths = np.full(len(words), FNV_OFFSET, np.uint64), np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == n)
        codes = np.array([words[i] for i in own], f"U{n}").view(np.uint32).reshape(len(own), n).astype(np.uint64)
        h = out[own]
        for j in range(n):
            h = ((h ^ codes[:, j]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        out[own] = h
    return out.astype(np.int64)


def jaro(a: str, b: str) -> tuple[float, int]:
    """Jaro similarity, and the length of the common prefix."""
    if a == b:
        return (1.0, len(a))
    if not a or not b:
        return (0.0, 0)
    if len(a) > len(b):  # the shorter one looks for its characters in the longer one
        a, b = b, a
    reach = max(0, len(b) // 2 - 1)
    used = [False] * len(b)
    ma = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                ma.append(c)
                break
    m = len(ma)
    if not m:
        return (0.0, 0)
    mb = [c for j, c in enumerate(b) if used[j]]
    t = sum(x != y for x, y in zip(ma, mb)) // 2  # whole transpositions
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return ((m / len(a) + m / len(b) + (m - t) / m) / 3, prefix)


def jaro_winkler_value(a: str, b: str, capped: bool = False) -> float:
    """capped: the usual bonus of 0.1 for each of up to 4 equal first characters; else min(0.1, 1 / longer length) for all equal ones."""
    j, prefix = jaro(a, b)
    if j < 0.7 or j == 1.0:
        return j
    return j + (0.1 * min(prefix, 4) if capped else min(0.1, 1 / max(len(a), len(b))) * prefix) * (1 - j)


def jaro_winkler(a: Column, b: Column, capped: bool = False) -> Column:
    """By Arrow batches; use it behind cheap filters. Null if either is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_value(p, q, capped) for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def hash_vector(words: list[str], dims: int = 768) -> np.ndarray:
    """A query's hash embedding on the driver: counts in FNV buckets, normalised."""
    v = np.zeros(dims)
    for w in words:
        h = FNV_OFFSET
        for c in w.encode("utf-16-le")[::2] if w.isascii() else [ord(c) for c in w]:
            h = ((h ^ c) * FNV_PRIME) & 0xFFFFFFFF
        v[h % dims] += 1
    n = np.sqrt((v**2).sum())
    return v / n if n > 1e-12 else v
