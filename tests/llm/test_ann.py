import numpy as np
import pytest

from symgraph.llm.ann import Tree, _sample, calibrate, grow, nearest_neighbours, shards
from symgraph.llm.queries import op6_nearest_neighbours


def brute(q, x, own):
    """All rows by distance from each query, but itself (the row of number own)."""
    d = (q.astype(float) ** 2).sum(1)[:, None] + (x.astype(float) ** 2).sum(1)[None] - 2 * q.astype(float) @ x.T.astype(float)
    d[np.arange(len(q)), own] = np.inf
    return np.argsort(d, 1, kind="stable")


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 64}, {"leaf_rows": 64, "sample_numbers": 64 * 500, "shard_rows": 300, "block_queries": 7}])
def test_recall_against_brute_force(spark, options):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    asked = np.flatnonzero(ids % 10 == 0)
    want = brute(x[asked], x, asked)[:, :10]
    got = {}
    for r in nearest_neighbours(df, query_every=10, **options).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbor_id, r.distance)
    assert set(got) == set(ids[asked])
    hits = [len({ids[j] for j in w} & {n for n, _ in got[ids[i]].values()}) for i, w in zip(asked, want)]
    assert np.mean(hits) >= 9
    for i, g in got.items():
        assert sorted(g) == list(range(1, 11)) and [g[i][1] for i in range(1, 11)] == sorted(g[i][1] for i in range(1, 11))
        assert all(abs(d - np.sqrt(((x[ids == i][0] - x[ids == n][0]) ** 2).sum())) < 1e-5 for n, d in g.values())


def test_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    asked = np.flatnonzero(ids % 50 == 0)
    want = {(ids[i], ids[j]) for i, near in zip(asked, brute(x[asked], x, asked)[:, :10]) for j in near}
    got = {(r.vec_id, r.neighbor_id) for r in op6_nearest_neighbours(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_best_bin_first_visits_every_leaf_once(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)).astype(np.float32)
    tree = grow(x, 20, branch=4)
    n = len(tree.leaves)
    own = tree.descend(x)
    for v in x[:50]:
        seen = tree.visits(v, n)
        assert sorted(seen) == list(range(n)) and tree.visits(v, 3) == seen[:3]
    assert len(np.unique(own)) == n and n >= 15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<float>")
    own, q = _sample(df, 50, 300)
    assert len(q) == 50 and calibrate(df, tree, q, own, 5, 1.0) >= calibrate(df, tree, q, own, 5, 0.5) >= 1
    assert len(Tree(np.zeros((1, 2), np.float32)).leaves) == 1


def test_a_full_visit_is_exact_with_ties_by_id(spark):
    """Lattice points have many ties, a third of all rows are equal, and leaves, shards and blocks are small."""
    r = np.random.default_rng(2)
    x = r.integers(0, 4, (240, 3)).astype(np.float32)
    x[r.permutation(240)[:80]] = 1
    ids = r.permutation(1000)[:240] - 300
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    want = {i: ids[w[:6]].tolist() for i, w in zip(ids.tolist(), brute(x, x, np.arange(240)))}
    got = {}
    for row in nearest_neighbours(df, k=6, recall=1.0, leaf_rows=10, shard_rows=25, block_queries=40).orderBy("vec_id", "rank").collect():
        got.setdefault(row.vec_id, []).append(row.neighbor_id)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)  # recall 1 is that of the queries that visits are calibrated on


def test_shards_keep_neighbours_together_and_split_large_leaves():
    first, parts = shards(np.array([3, 4, 0, 25, 2, 9]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1]


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS leaf", "3 AS distance")
    got = {(r.vec_id, r["rank"]): (r.neighbor_id, r.distance) for r in nearest_neighbours(df, k=5).collect()}
    assert got == {(1, 1): (2, 0), (1, 2): (3, 1.414214), (2, 1): (1, 0), (2, 2): (3, 1.414214), (3, 1): (1, 1.414214), (3, 2): (2, 1.414214)}
    assert nearest_neighbours(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert nearest_neighbours(same, k=3, leaf_rows=4).count() == 150
    with pytest.raises(ValueError):
        nearest_neighbours(same, k=0)
