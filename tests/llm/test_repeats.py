import random
import re
from collections import defaultdict

import numpy as np
import pytest

from symgraph.llm import suffix_array as A
from symgraph.llm import suffix_tree as T


def brute(docs, m, within=False):
    """Spans of runs of m words that are in documents with two ids (or at two places), straight from the definition."""
    runs = defaultdict(set)
    times = defaultdict(int)
    words = [(d, re.findall(r"[^\x00-\x20]+", t)) for d, t in (dict.fromkeys(docs) if within else docs) if d is not None and t is not None]
    for d, w in words:
        for i in range(len(w) - m + 1):
            runs[tuple(w[i : i + m])].add((d, i) if within else d)
            times[tuple(w[i : i + m])] += 1
    out = set()
    for d, w in words:
        spans = []
        for i in range(len(w) - m + 1):
            if len(runs[tuple(w[i : i + m])]) > 1:
                n = len(runs[tuple(w[i : i + m])]) if within else times[tuple(w[i : i + m])]
                if spans and i <= spans[-1][1]:
                    spans[-1] = [spans[-1][0], i + m, max(n, spans[-1][2])]
                else:
                    spans.append([i, i + m, n])
        out |= {(d, a, b, b - a, n) for a, b, n in spans}
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "é", "x" * 30] if seed % 2 else [f"w{i}" for i in range(40)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(5, 25))] for _ in range(4)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(r.randint(0, 5)):
            words += [r.choice(vocabulary) for _ in range(r.randint(0, 15))] + (r.choice(shared) if r.random() < 0.4 else [])
        docs.append((i, r.choice([" ", "\n", "  "]).join(words)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (None, docs[3][1]), (102, None), (103, ""), (104, "z " * 50), (105, "z " * 45)]
    return docs


@pytest.mark.parametrize("kernel", [A, T])
@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, kernel, seed):
    docs = corpus(seed)
    op = A.suffix_array_dedup if kernel is A else T.suffix_tree_dedup
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS win", "3 AS s", "4 AS shard")
    rows = op(df, min_words=8).collect()
    assert {tuple(r) for r in rows} == brute(docs, 8)
    assert len(rows) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("op", [A.suffix_array_dedup, T.suffix_tree_dedup])
def test_hot_anchors_and_empty(spark, op):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in op(df, min_words=8, shard_words=20).collect()} == brute(docs, 8)
    assert op(df.limit(0)).collect() == []
    assert op(df.where("doc_id = 3").union(df.where("doc_id = 3")), min_words=2).collect() == []


OPS = [A.suffix_array_dedup, T.suffix_tree_dedup]


@pytest.mark.parametrize("op", OPS)
def test_repeats_within_a_document(spark, op):
    for seed in (0, 1):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert {tuple(r) for r in op(df, min_words=8, within=True).collect()} == brute(docs, 8, within=True)
        assert {tuple(r) for r in op(df, min_words=8, within=True, shard_words=20).collect()} == brute(docs, 8, within=True)


@pytest.mark.parametrize("op", OPS)
def test_an_id_with_two_texts(spark, op):
    r = random.Random(5)
    word = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = word(50)
    docs = [(1, " ".join(word(150))), (1, " ".join(word(30) + passage + word(30))), (2, " ".join(word(70) + passage + word(10)))]
    want = {(1, 30, 80, 50, 2), (2, 70, 120, 50, 2)}
    assert brute(docs, 50) == want
    for rows in (docs, docs[::-1], [docs[1], docs[0], docs[2]]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {tuple(x) for x in op(df).collect()} == want


@pytest.mark.parametrize("op", OPS)
def test_very_long_texts(spark, op):
    r = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    long = [f"w{r.randrange(10**6)}" for _ in range(400_000)]
    docs = [(1, " ".join(long + passage)), (2, "x" * 3_000_000 + " " + " ".join(passage)), (3, "y" * 3_000_000)]
    got = {tuple(x) for x in op(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 400_000, 400_060, 60, 2), (2, 1, 61, 60, 2)}


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 50):
        for n in (0, 1, 2, 30, 300):
            s = np.append(r.integers(1, alphabet + 1, n), 0)
            want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
            sa = A.suffix_array(s)
            assert sa.tolist() == want
            shared = A.permuted_common_prefixes(s, sa)
            for k in range(1, n + 1):
                a, b = s[want[k - 1] :], s[want[k] :]
                m = min(len(a), len(b))
                d = np.flatnonzero(a[:m] != b[:m])
                assert shared[want[k]] == (d[0] if len(d) else m)


def test_tree_groups_hold_every_suffix_once_and_in_order():
    r = np.random.default_rng(2)
    s = np.append(r.integers(1, 4, 400), 0)
    groups = list(T.prefix_groups(s, np.arange(401), 500, most=10))
    assert sorted(np.concatenate([g for g, _ in groups]).tolist()) == list(range(401))
    for g, depth in groups:
        assert len({tuple(s[i : i + depth]) for i in g}) == 1
    for suffixes, group, depth in T.virtual_trees(iter(groups), most=30):
        leaves, branch = T.leaves_and_branches(s, suffixes, group, depth)
        for k in set(group.tolist()):
            mine = group == k
            assert leaves[mine].tolist() == sorted(suffixes[mine].tolist(), key=lambda i: s[i:].tolist())
            for a, b, n in zip(leaves[mine], leaves[mine][1:], branch[mine][1:]):
                assert s[a : a + n].tolist() == s[b : b + n].tolist() and s[a : a + n + 1].tolist() != s[b : b + n + 1].tolist()


def test_a_large_group_is_not_split_below_its_deep_node():
    s = np.append(np.tile([1, 2, 3], 50), 0)
    assert max(d for _, d in T.prefix_groups(s, np.arange(100), 4, most=5)) <= 4
