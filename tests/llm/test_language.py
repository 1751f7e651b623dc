import itertools

import numpy as np
import pytest

from symgraph.llm import language as L


def test_posteriors_against_enumeration():
    r = np.random.default_rng(1)
    m = 3
    start, trans = r.normal(size=m), r.normal(size=(m, m))
    sizes = [0, 1, 2, 7, 0, 5, 8]
    offsets = np.append(0, np.cumsum(sizes))
    scores = r.normal(size=(offsets[-1], m)) * 2
    got = L.posteriors(scores, offsets, start, trans, chunk=3)
    for a, n in zip(offsets, sizes):
        want = np.zeros((n, m))
        for path in itertools.product(range(m), repeat=n):
            w = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(trans[p, q] for p, q in zip(path, path[1:])) + (start[path[0]] if n else 0))
            for i, y in enumerate(path):
                want[i, y] += w
        if n:
            assert np.allclose(got[a : a + n], want / want.sum(1, keepdims=True), atol=1e-4)


def test_long_text_needs_no_other_chunks():
    r = np.random.default_rng(2)
    scores = r.normal(size=(1000, 4))
    a = L.posteriors(scores, np.array([0, 1000]), np.zeros(4), r.normal(size=(4, 4)) * 0, chunk=64)
    b = L.posteriors(scores, np.array([0, 1000]), np.zeros(4), np.zeros((4, 4)), chunk=7)
    assert np.allclose(a, b, atol=1e-4) and np.allclose(a.sum(1), 1, atol=1e-5)


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(3)
    score, y, start, trans = r.normal(size=(2, 4, 3)), r.integers(0, 3, (2, 4)), r.normal(size=3), r.normal(size=(3, 3))

    def likelihood(s, t):
        total = 0
        for k in range(2):
            w = {p: sum(s[k, i, q] for i, q in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) + start[p[0]] for p in itertools.product(range(3), repeat=4)}
            total += w[tuple(y[k])] - np.log(sum(np.exp(v) for v in w.values()))
        return total

    g, pairs = L._gradient(score, y, start, trans)
    for i in ((0, 1, 2), (1, 3, 0)):
        d = np.zeros_like(score)
        d[i] = 1e-5
        assert g[i] == pytest.approx((likelihood(score + d, trans) - likelihood(score - d, trans)) / 2e-5, abs=1e-5)
    d = np.zeros((3, 3))
    d[1, 2] = 1e-5
    assert pairs[1, 2] == pytest.approx((likelihood(score, trans + d) - likelihood(score, trans - d)) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def crf(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))


def test_held_out_documents_and_switched_words(spark, crf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 1 AND n_chars > 100")
    got = L.identify_language(docs, crf=crf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.98 and np.mean([r.accepted for r in got]) > 0.99
    by = {r.lang: r.text for r in docs.where("n_chars BETWEEN 500 AND 900").select("lang", "text").collect()}
    en, de = by["en"].split()[:50], by["de"].split()[:50]
    row = L.identify_language(spark.createDataFrame([(1, " ".join(en + de + en))], "doc_id long, text string"), crf=crf).first()
    assert row.language == "en" and 0.55 < row.share < 0.78 and 2 <= row.n_switches <= 12


def test_edges(spark, crf):
    docs = spark.createDataFrame([(1, None, "en", 5), (2, "", "en", 5), (3, "123 !!", "de", 5), (None, "the of and", None, 5), (4, "the of and", "en", 5), (4, "the of and", "en", 5), (5, "the and of " * 20000, "en", 5)], "doc_id long, text string, lang string, share int")
    got = L.identify_language(docs, crf=crf).collect()
    assert len(got) == 7 and [r.accepted for r in sorted(got, key=lambda r: r.n_words)] == [False] * 3 + [True] * 4
    assert all(r.language is None and r.share is None for r in got if not r.n_words)
    assert L.identify_language(docs.limit(0)).collect() == []
    assert not any(r.accepted for r in L.identify_language(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect())
    kept = L.in_a_language(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema and kept.count() == 4


def test_a_rare_language_and_repeated_rows_in_the_training_sample(spark):
    """A language of few rows is learned beside one with most of them, half of which are one row again and again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 200 AND 900")
    de, en = docs.where("lang = 'de'").orderBy("doc_id"), docs.where("lang = 'en'").orderBy("doc_id")
    rows = de.limit(4).union(en.limit(150)).union(en.limit(1).join(spark.range(200)).drop("id"))
    for a, b in ((rows, rows.repartition(7)), (rows.withColumn("doc_id", L.F.lit(None)), rows.withColumn("doc_id", L.F.lit(None)).coalesce(1))):
        one, two = L.train(a, max_rows=40, per_language=20), L.train(b, max_rows=40, per_language=20)
        assert one.languages == two.languages == ["de", "en"] and (one.weights == two.weights).all()
    held = de.join(de.limit(4), "doc_id", "left_anti").limit(20)
    assert [r.language for r in L.identify_language(held, crf=one).collect()].count("de") >= 17
    assert len(L.train(rows, max_rows=1).languages) == 1
