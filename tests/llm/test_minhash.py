import random
import re

import numpy as np
import pytest

from symgraph.llm import minhash as M
from symgraph.llm.components import components
from symgraph.llm.minhash import least_matches, minhash_near_dedup


def shingle_set(text, k):
    w = re.findall(r"[^\x00-\x20]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def corpus(seed, n=120):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and r.random() < 0.5:
            w = r.choice(docs)[1].split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"e{r.random()}"
        else:
            w = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(20, 90))]
        docs.append((i, " ".join(w)))
    return docs + [(500, docs[0][1].upper()), (500, docs[0][1].upper()), (501, "one two"), (502, "One  two\n"), (503, ""), (504, None), (None, docs[0][1]), (505, "  ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_against_all_pairs(spark, seed):
    docs = corpus(seed)
    found = {r.doc_id: r.group_id for r in minhash_near_dedup(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS band", "2 AS same", "3 AS a")).collect()}
    sets = {d: shingle_set(t, 3) for d, t in docs if d is not None and t}
    ids = sorted(d for d in sets if sets[d])
    pairs = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    want = groups_of(pairs)
    assert sum(found.get(a) == found.get(b) is not None for a, b in pairs) >= 0.95 * len(pairs)
    for x, g in found.items():
        assert want[x] == want[g]
    assert found[500] == found[0] == 0 and found[501] == found[502] == 501 and 503 not in found


def test_a_bucket_member_unlike_the_least_id_still_finds_its_partner(spark):
    r = random.Random(5)
    docs = []
    base = [f"w{i}" for i in range(60)]
    for i in range(80):  # a chain: neighbours alike, far ones not
        base = base[3:] + [f"n{r.random()}" for _ in range(3)]
        docs.append((i, " ".join(base)))
    found = {x.doc_id: x.group_id for x in minhash_near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(found) == 80 and len(set(found.values())) <= 2


@pytest.mark.parametrize("block", [3, 1024])
def test_a_bucket_of_unlike_documents_is_searched_whole(spark, monkeypatch, block):
    """One band for all: groups are those of all pairs, however the bucket is cut into blocks."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SHARD_ROWS", 20)
    r = random.Random(9)
    common = [f"c{i}" for i in range(24)]
    docs = [(i, " ".join(common + [f"u{r.random()}" for _ in range(40)])) for i in range(40)]
    for i in range(40, 60):  # partners of some, none of them of the least id
        w = docs[i - 39][1].split()
        w[30] = f"e{i}"
        docs.append((i, " ".join(w)))
    sketch = M._sketch
    monkeypatch.setattr(M, "_sketch", lambda size: one_band(sketch(size)))
    found = {x.doc_id: x.group_id for x in minhash_near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {d: shingle_set(t, 3) for d, t in docs}
    assert found == groups_of([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])])


def one_band(run):
    import pyarrow as pa

    def same(batches):
        for b in run(batches):
            n = b.num_rows
            yield b.set_column(b.num_columns - 1, "bands", pa.array([[7]] * n, pa.list_(pa.int64())))

    return same


def test_empty(spark):
    assert minhash_near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_posterior_table_grows_and_is_lenient():
    t = least_matches(0.5, 0.001)
    assert t == sorted(t) and all(m <= 0.5 * 16 * (i + 1) for i, m in enumerate(t)) and t[-1] > 40
    assert np.all(np.array(least_matches(0.5, 1e-9)) <= np.array(t))


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r.id: r.label for r in components(e).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {8: 8, 9: 8} | {i: 100 for i in range(100, 161)}
