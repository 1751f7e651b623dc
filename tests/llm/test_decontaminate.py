import random
import re

import numpy as np
import pyarrow as pa
import pytest

from symgraph.llm import decontaminate as D
from symgraph.llm.textblock import split


def brute(docs, bench, threshold, radius, size):
    """Every window of every document with every item."""
    best = {}
    items = D.prepare([(i, t.lower()) for i, t in bench if t], size, radius, threshold)
    for d, t in docs:
        if d is None or not t:
            continue
        w = split(pa.array([t.lower()]))
        v, g = D.shingled(w, size)
        for k, i in enumerate(items.ids):
            n = min(int(items.words[k]), len(w.hashes))  # a shorter text is a window of its own
            for s in range(len(w.hashes) - n + 1 if n >= size else 0):
                a, b = v[s : s + n - size + 1], g[s : s + n - size + 1]
                if int(D.apart(D.simhash(a, b), items.fingerprints[k])) <= radius:
                    j = D.weighted_jaccard(a, b, items.shingles[k], items.weights[k])
                    if j >= threshold and (-j, s) < best.get((d, i), (1, 0))[:2]:
                        best[d, i] = (-j, s, n)
    return {(d, i, s, n, round(-j, 9)) for (d, i), (j, s, n) in best.items()}


def world(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "a", "to"]) if r.random() < 0.4 else f"w{r.randint(0, 500)}x"
    bench = [(i, " ".join(word() for _ in range(r.choice([12, 20, 21])))) for i in range(12)]
    docs = []
    for i in range(40):
        w = [word() for _ in range(r.randint(0, 60))]
        if i % 2:
            p = r.choice(bench)[1].split()
            for _ in range(r.randint(0, 5)):
                p[r.randrange(len(p))] = word()
            k = r.randint(0, len(w))
            w[k:k] = p
        docs.append((i, " ".join(w)))
    return docs, bench


@pytest.mark.parametrize("seed,radius,threshold", [(1, 36, 0.5), (2, 50, 0.3), (3, 6, 0.7), (4, 0, 0.9), (5, 127, 0.2)])
def test_against_all_windows(spark, seed, radius, threshold):
    docs, bench = world(seed)
    docs += [(3, docs[3][1]), (None, bench[0][1]), (60, None), (61, ""), (62, "a"), (63, bench[1][1].upper()), (64, bench[1][1] + " " + bench[1][1])]
    docs += [(65, bench[2][1].rpartition(" ")[0]), (66, " ".join(bench[3][1].split()[:3])), (67, "w1x " + " ".join(bench[4][1].split()[2:])), (1, bench[5][1])]
    more = bench + [(None, "x y z"), (90, None), (91, ""), (92, "one"), bench[0]]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity"), spark.createDataFrame(more, "item_id long, text string").selectExpr("*", "1 AS doc_id"), threshold, radius).collect()
    assert {(*r[:4], round(r[4], 9)) for r in got} == brute(docs, bench, threshold, radius, 2)
    assert (63, 1, 0, len(bench[1][1].split()), 1.0) in {(*r[:4], round(r[4], 9)) for r in got}
    assert len(got) > 3


def test_recall_of_windows_at_the_threshold(spark):
    r = random.Random(5)
    rows = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").limit(15).collect()
    bench = [(x.item_id, x.text) for x in rows]
    words = [w for _, t in bench for w in t.split()]
    docs = []
    for k in range(120):
        p = bench[k % len(bench)][1].split()
        for _ in range(r.randint(1, max(1, len(p) // 5))):
            p[r.randrange(len(p))] = r.choice(words)
        docs.append((k, " ".join([r.choice(words), *p, r.choice(words)])))
    want = brute(docs, bench, 0.5, 128, 2)  # all windows, whatever their SimHash
    got = {(*x[:4], round(x[4], 9)) for x in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    near = {x[:2] for x in want if x[4] < 0.65}
    assert len(near) > 30 and len(near & {x[:2] for x in got}) >= 0.95 * len(near)
    assert len(got & want) >= 0.95 * len(want)


def test_blocks_find_all_within_radius():
    r = np.random.default_rng(1)
    for radius in (0, 3, 7, 16, 40, 127):
        items = D.Items(list(range(300)), [], [], np.full(300, 5), r.integers(0, 2**64, (300, 2), np.uint64), np.zeros(0, np.uint64), 2, radius, 0.5, {5: np.arange(300)})
        prints = items.fingerprints[r.integers(0, 300, 200)].copy()
        for k in range(200):
            for bit in r.choice(128, min(128, r.integers(0, radius + 3)), replace=False):
                prints[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        w, i = items.near(5, prints)
        want = {(a, b) for a in range(200) for b in range(300) if int(D.apart(prints[a], items.fingerprints[b])) <= radius}
        assert set(zip(w.tolist(), i.tolist())) == want and len(w) == len(want)


def test_items_of_many_lengths_and_a_very_long_text(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(3000)}"
    bench = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([2, 3, 5, 9, 17, 40, 200, 3000])]
    long = [word() for _ in range(60_000)]
    for k, (_, t) in enumerate(bench):
        long[7000 * k + 100 : 7000 * k + 100] = t.split()
    docs = [(1, " ".join(long)), (2, "x" * 2_000_000), (3, " ".join(bench[7][1].split()[:2000]))]
    got = {x[:2]: x[2:] for x in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), 0.6).collect()}
    assert {k for k in got if k[1] >= 2} == {(1, i) for i in range(2, 8)} | {(3, 7)}
    assert all(got[1, i][2] == 1.0 and got[1, i][1] == len(bench[i][1].split()) for i in range(2, 8)) and got[3, 7][:2] == (0, 2000)


def test_empty_and_kept_columns(spark):
    docs, bench = world(1)
    d = spark.createDataFrame([(*x, "k") for x in [*docs, (None, "q")]], "doc_id long, text string, source string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert D.contamination(d.limit(0), b).collect() == [] and D.contamination(d, b.limit(0)).collect() == []
    odd = d.selectExpr("*", "1 AS contaminated", "2 AS __bad", "3 AS item_id", "named_struct('a b', 1) AS `x y`")
    assert D.decontaminated(odd, b).columns == odd.columns and D.decontaminated(odd, b).count() == D.decontaminated(d, b).count()
    assert D.decontaminated(d.limit(0), b).collect() == [] and D.decontaminated(d, b.limit(0)).count() == d.count()
    kept = D.decontaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {None, 0, 2, 4}
    with pytest.raises(ValueError):
        D.contamination(d, b, max_items=3)
    assert re.match("doc_id", kept.columns[0])
