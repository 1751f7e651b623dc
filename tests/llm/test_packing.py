import itertools
import random
import re

import pytest

from symgraph.llm.packing import closest, pack_windows, plan


def test_closest_against_all_multisets():
    r = random.Random(1)
    for _ in range(200):
        room = r.randint(0, 30)
        counts = {k: r.randint(0, 4) for k in r.sample(range(1, 20), r.randint(0, 5))}
        used = closest(room, counts)
        assert all(0 < n <= counts[k] for k, n in used.items())
        best = max(t for t in (sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*(range(c + 1) for c in counts.values()))) if t <= room)
        assert sum(k * n for k, n in used.items()) == best


def test_plan_uses_every_piece_once_and_wastes_little():
    r = random.Random(2)
    counts = {k: r.randint(1, 300) for k in r.sample(range(1, 513), 200)}
    fillings = plan(counts, 512)
    total = {}
    for used, times in fillings:
        assert sum(k * n for k, n in used.items()) <= 512
        for k, n in used.items():
            total[k] = total.get(k, 0) + n * times
    assert total == counts
    windows, tokens = sum(t for _, t in fillings), sum(k * n for k, n in counts.items())
    alone = sum(n for k, n in counts.items() if k > 256)  # no two of them fit together
    assert windows <= max(tokens / 512, alone) * 1.01 + 1 and len(fillings) < 1500


@pytest.mark.parametrize("bucket_rows", [5, 1000])
def test_round_trip(spark, bucket_rows):
    r = random.Random(3)
    texts = [" ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 2, 5, 9, 10, 11, 25, 100]))) for _ in range(200)]
    docs = [*enumerate(texts), (3, texts[3]), (None, "a b c"), (900, None), (901, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "3 AS piece", "4 AS length")
    rows = pack_windows(df, 10, bucket_rows=bucket_rows).collect()
    words = {}
    for d, t in docs:
        n = len(re.findall(r"[^\x00-\x20]+", t or ""))
        if n:
            words.setdefault(d, []).append(n)
    got = {}
    for x in rows:
        got.setdefault(x.doc_id, []).append((x.start, x.length))
        assert x.start == 10 * x.piece
    for d, sizes in words.items():
        assert sorted(got.pop(d)) == sorted((i, min(10, n - i)) for n in sizes for i in range(0, n, 10))
    assert not got
    by = {}
    for x in rows:
        by.setdefault(x.window_id, []).append((x.place, x.length))
    assert sorted(by) == list(range(len(by)))
    for w in by.values():
        w.sort()
        assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and sum(n for _, n in w) <= 10
    assert len(by) <= sum(map(sum, words.values())) / 10 * 1.03 + 1
    again = pack_windows(df.repartition(7), 10, bucket_rows=bucket_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty(spark):
    assert pack_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pack_windows(spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, 0)], "doc_id long, k int"), 4, length_col="k").count() == 2
