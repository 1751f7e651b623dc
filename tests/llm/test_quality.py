import math
import random
import re

import numpy as np
import pyarrow as pa

from symgraph.llm.quality import FEATURES, PAIRS, bradley_terry, features, quality_scores


def test_weights_rank_as_the_pairs_say():
    r = np.random.default_rng(1)
    truth = np.array([2.0, -1.0, 0.0])
    x = r.normal(size=(600, 3))
    y = x @ truth + r.logistic(size=600) > 0
    w = bradley_terry(x[y], x[~y])
    assert np.corrcoef(x @ w, x @ truth)[0, 1] > 0.98
    g = bradley_terry(np.array([[1.0, 0.0]]), np.array([[0.0, 0.0]]), ridge=0.1)
    assert g[0] > 0 and g[1] == 0 and abs(1 / (1 + np.exp(g[0])) - 0.1 * g[0]) < 1e-6


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.keep for r in got if r.quality == 1]) > 0.98
    assert np.mean([not r.keep for r in got if r.quality == 0]) > 0.95


def test_threshold_is_over_all_good_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = quality_scores(docs, labels, 0.1, max_rows=40).join(labels.where("quality = 1"), "doc_id").where("score IS NOT NULL").collect()
    least = np.quantile([r.score for r in good], 0.1)
    assert len(good) > 100 and [r.keep for r in good] == [r.score >= least - 2e-9 for r in good]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "Good words here. And there."), (1, "Good words here. And there."), (2, "!!!! ### bad### bad###"), (3, None), (4, ""), (None, "Some words."), (5, "x " * 100000)], "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS y", "0 AS x")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 7 and sorted((r.doc_id, r.keep) for r in got if r.doc_id in (1, 2, 3, 4)) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert all((r.score is None) == (r.doc_id in (3, 4)) for r in got)
    none = quality_scores(docs, labels.limit(0)).collect()
    assert [r.keep for r in none].count(True) == 5
    assert quality_scores(docs.limit(0), labels).collect() == []


def test_features_of_a_known_text():
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(["", "Ab c1!! Ab.\nAb c1!! x"])], ["doc_id", "text"])
    (out,) = features(iter([batch]))
    x = dict(zip(FEATURES, out.column(1).to_pylist()[0]))
    assert out.column(0).to_pylist() == [8]
    assert x["letters"] == 9 / 16 and x["upper"] == 3 / 16 and x["digits"] == 2 / 16 and x["marks"] == 5 / 16
    assert x["unique_words"] == 4 / 6 and x["repeated_lines"] == 0 and x["stops"] == 3 / 6 and x["mark_runs"] == 2 / 6


def plain(text):
    """The features by their definitions, a word at a time; None for a text without words."""
    split = lambda raw: re.findall(rb"[^\x00-\x20]+", raw)
    words = split(text.encode())
    if not words:
        return None
    chars, k = sum(map(len, words)), len(words)
    mark = lambda c: 33 <= c < 127 and not chr(c).isalnum()
    odd = lambda c: mark(c) and chr(c) not in ".,;:'\"?()-"
    count = lambda kind: sum(kind(c) for w in words for c in w) / chars
    share = lambda kind: sum(map(kind, words)) / k
    lines = [tuple(w) for w in map(split, text.encode().split(b"\n")) if w]
    return [
        count(lambda c: c > 127 or chr(c).isalpha()), count(lambda c: 65 <= c <= 90), count(lambda c: 48 <= c <= 57), count(mark), count(odd), share(lambda w: w[-1:] in (b".", b"?", b"!")), min(chars / k, 30) / 10, share(lambda w: len(w) > 20), len(set(words)) / k,
        sum(a == b for a, b in zip(words, words[1:])) / k, (len(lines) - len(set(lines))) / len(lines), min(math.log1p(k), 8) / 8, share(lambda w: any(map(odd, w))), share(lambda w: any(a == b and mark(a) for a, b in zip(w, w[1:]))),
    ]


def odd_texts():
    r = random.Random(3)
    pieces = ["foo", "foo\n", "\n", " ", "\n  bar", "!!", "!", "é", "x1,", "W" * 25, "foo bar\n", "foo baz\n", "\t", "..", "ab--c", "?", "\x00", "日本 ", "\r\n"]
    return ["foo\nfoo", "foo\nbar", "hi!", "!x", "a b\na c\na d", "", "\n", "foo"] + ["".join(r.choices(pieces, k=r.randrange(30))) for _ in range(300)]


def test_features_against_their_definitions_under_any_batching(spark):
    texts = odd_texts()
    want = [plain(t) for t in texts]
    for size in (1, 7, len(texts)):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, min(lo + size, len(texts)))), pa.array(texts[lo : lo + size])], ["doc_id", "text"]) for lo in range(0, len(texts), size)]
        got = {}
        for out in features(iter(batches)):
            got |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
        assert set(got) == {i for i, w in enumerate(want) if w}
        for i, x in got.items():
            assert np.allclose(x, want[i], rtol=0, atol=1e-12), (texts[i], x, want[i])


def test_scores_keep_and_fit_against_brute_force(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int("W" not in t and len(t) > 10)) for i, t in rows if i % 3]
    df, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    x = {i: np.array(plain(t)) for i, t in rows if plain(t)}
    good, bad = (np.array(sorted(x[i].tolist() for i, y in labels if y == k and i in x)) for k in (1, 0))
    order = lambda v: v[np.lexsort(v.T)]
    good, bad = order(good), order(bad)
    w = bradley_terry(good, bad)
    # the gradient of the penalised likelihood over the same pairs, added up one by one, is zero at the weights
    r = np.random.default_rng(0)
    pairs = list(zip(np.repeat(np.arange(len(good)), PAIRS), r.integers(0, len(bad), len(good) * PAIRS)))
    pairs += list(zip(r.integers(0, len(good), len(bad) * PAIRS), np.repeat(np.arange(len(bad)), PAIRS)))
    gradient = sum((good[g] - bad[b]) / (1 + math.exp(sum(w * (good[g] - bad[b])))) for g, b in pairs) / len(pairs) - 1e-3 * w
    assert np.abs(gradient).max() < 1e-8
    scores = {i: float(sum(w * v)) for i, v in x.items()}
    threshold = np.quantile([scores[i] for i, y in labels if y == 1 and i in scores], 0.05)
    for parts in (1, 5):
        got = {q.doc_id: q for q in quality_scores(df.repartition(parts), marked, 0.05).collect()}
        assert len(got) == len(rows)
        for i in got:
            assert (got[i].score is None) == (i not in scores) and got[i].keep == (i in scores and scores[i] >= threshold - 1e-9)
            assert i not in scores or abs(got[i].score - scores[i]) < 1e-6
