"""What keeps work and memory in proportion to the input: plans, and results where rows repeat."""


import re

import numpy as np
from pyspark.sql import functions as F

from symgraph.functions import similarity as S
from symgraph.functions import text as T
from symgraph.operators import graph, lexical, vectors
from symgraph.operators import pagerank as ranking
from symgraph.plans import catalogue, trade


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_not_counted_again_by_text(spark, sf):
    assert "hashpartitioning(src" not in plan(trade.edges(spark, sf))


def test_parts_grow_with_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(trade, "PART_BYTES", 1024)
    parts = trade.partitions(spark, sf)
    assert parts > 20 and f", {parts})" in plan(trade.calls(spark, sf))
    assert "hashpartitioning(src#" in plan(a := graph.adjacency(trade.edges(spark, sf), partitions=parts)) and f", {parts})" in plan(a)


def test_valid_by_broadcast_and_by_shuffle(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "Calls", 2), ("a", "x", "Calls", 1), (None, "b", "Calls", 1)], "src string, dst string, kind string, n long")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    expected = [("a", "b", "Calls", 2)]
    assert list(map(tuple, graph.valid(edges, nodes).collect())) == expected
    monkeypatch.setattr(graph, "BROADCAST_IDS", 1)
    monkeypatch.setattr(graph.few, "__defaults__", (1,))
    assert list(map(tuple, graph.valid(edges, nodes, partitions=3).collect())) == expected


def test_repeated_bindings_are_counted(spark, sf, tmp_path):
    for t in ("customer", "supplier"):
        rows = trade.table(spark, sf, t)
        rows.union(rows).write.parquet(f"{tmp_path}/{t}.parquet")
    assert {r.n for r in trade.bindings(spark, str(tmp_path)).select("n").distinct().collect()} == {2}


def test_pagerank_over_several_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(ranking, "CHUNK", 3)
    n = 40
    pairs = [(f"n{i}", f"n{i * i % 7}", 1 + i % 3) for i in range(n - 5)] + [("n1", "n2", 300), ("n3", None, 2), (None, "n3", 1), ("n4", "elsewhere", 5), ("elsewhere", "n5", 1)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(a, b, "Calls", k) for a, b, k in pairs], "src string, dst string, kind string, n long")
    ids, out, score = [f"n{i}" for i in range(n)], {}, dict.fromkeys([f"n{i}" for i in range(n)], 1 / n)
    for a, _, k in pairs:
        out[a] = out.get(a, 0) + k
    for _ in range(3):
        lost = sum(score[i] for i in ids if i not in out)
        score = {i: 0.15 / n + 0.85 * (sum(score.get(a, 0) * k / out[a] for a, b, k in pairs if b == i) + lost / n) for i in ids}
    got = {r.id: r.score for r in ranking.pagerank(nodes, edges, iterations=3, tolerance=0).collect()}
    assert got.keys() == score.keys() and max(abs(got[i] - score[i]) for i in ids) < 1e-12


def test_rounds_of_pagerank_shuffle_no_edges(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "Calls", 1)], "src string, dst string, kind string, n long")
    g = ranking.Blocks(ids, 2)
    files, alone = g.write(edges)
    assert alone == 1 and g.round(files, None, f"{g.folder}/new", 0.1, 0.85) is not None
    assert "Exchange" not in plan(g.ranks(f"{g.folder}/new"))


def test_tokens_in_one_pass(spark):
    texts = ["..a. b .. c..d ...", "...", "", None, "x_1.y!?.z.", "the.end. the", "é.è\n..ü.\n", ".5 a. .b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = [None if t is None else [w for w in (v.strip(".") for v in re.split(r"[^\w.]+", t.lower())) if w and w not in T.STOP_WORDS] for t in texts]
    assert [r.w for r in df.select(T.tokens(F.col("t")).alias("w")).collect()] == expected
    assert "regexp_replace" not in plan(df.select(T.tokens(F.col("t"))))


def test_words_are_counted_where_their_document_is(spark):
    docs = spark.createDataFrame([(1, "en", "a1 b1 a1"), (2, "en", "a1")], "doc_id long, lang string, text string")
    words = {"text": T.tokens(F.col("text"))}
    for posted in (lexical.postings(docs, "doc_id", words), lexical.index_postings(docs, "doc_id", words)):
        assert plan(posted).count("Exchange") == 1 and {(r.term, r.doc_id): r.tf for r in posted.collect()} == {("a1", 1): 2, ("b1", 1): 1, ("a1", 2): 1}
    lengths = lexical.doc_lengths(docs, "doc_id", words)
    assert "Exchange" not in plan(lengths) and {r.doc_id: r.dl for r in lengths.collect()} == {1: 3, 2: 1}


def test_scores_make_the_words_once(spark):
    docs = spark.createDataFrame([(1, "a1 b1"), (2, "b1 c1")], "doc_id long, text string")
    assert "split(" not in plan(lexical.scores(docs, "doc_id", {"text": T.tokens(F.col("text"))}, "a1 c1"))


def test_hash_embed_adds_up_rows_of_one_id(spark):
    words = ["héllo", "a", "a", "𝔘x", "b.c"]
    docs = spark.createDataFrame([(1, words[:3]), (1, words[3:]), (2, []), (3, None), (4, ["a"])], "id long, w array<string>")
    df = vectors.hash_embed(docs, "id", F.col("w"), 64)
    got = {r.id: r.vector for r in df.collect()}
    assert got.keys() == {1, 4} and "explode" not in plan(df).lower()
    own = spark.createDataFrame([(w,) for w in words], "w string").select((S.fnv1a(F.col("w")) % 64).alias("b")).collect()
    v = np.bincount([r.b for r in own], minlength=64) / 1.0
    assert np.allclose(got[1], v / np.sqrt((v**2).sum()), atol=1e-6)


def test_an_indexed_query_makes_only_its_part(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(catalogue, "_BUILT", {})
    monkeypatch.setattr(catalogue, "_PARTS", {p: lambda *_, p=p: made.append(p) for p in ("lexical", "vectors", "graph")})
    for _ in range(2):
        catalogue.prepared(spark, sf, "graph")
    assert made == ["graph"]
    catalogue.prepared(spark, sf, "lexical", "graph")
    assert made == ["graph", "lexical"]


def test_pairs_of_references_are_not_shuffled(spark):
    refs = spark.createDataFrame([(f"p{i}", name, "References") for i in range(40) for name in ("Foo", "x.bar", "Foo")] + [("q", "foo", "Calls"), (None, "foo", "Calls"), ("q", "none", "Calls")], "src string, ref_name string, kind string")
    symbols = spark.createDataFrame([(f"d{i}", name) for i in range(30) for name in ("foo", "bar")] + [("d0", "FOO"), ("e", None)], "id string, symbol_name string")
    df = graph.resolve(refs, symbols, "suffix")
    assert plan(df).count("Exchange") == plan(df).count("BroadcastExchange") + plan(df).count("hashpartitioning(class")
    got = {(r.src, r.dst, r.kind): r.n for r in df.collect()}
    assert len(got) == 40 * 30 + 30 + 30 and got["p1", "d1", "References"] == 3 and got["p1", "d0", "References"] == 5 and got["q", "d0", "Calls"] == 2 and got[None, "d5", "Calls"] == 1
