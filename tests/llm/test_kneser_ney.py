import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from symgraph.llm import kneser_ney as K
from symgraph.llm import queries as Q


def brute(docs, least):
    """Modified Kneser-Ney by dictionaries."""
    seqs = [["<p>", "<s>", *w, "</s>"] for w in (re.findall(r"[^\x00-\x20]+", (t or "").lower()) for t in docs) if w]
    tri = Counter((s[i - 2], s[i - 1], s[i]) for s in seqs for i in range(2, len(s)))
    bi = Counter((b, c) for a, b, c in tri)
    uni = Counter(c for b, c in bi)

    def level(counts, least):
        d = (0, *K.discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]))
        total, given = defaultdict(int), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            if n >= least:
                given[g[:-1]] += n - d[min(n, 3)]
        return d, total, given

    levels = [level({(c,): n for c, n in uni.items()}, 1), level(bi, least), level(tri, least)]
    tables = [{(c,): n for c, n in uni.items()}, bi, tri]

    def p(gram):
        k = len(gram) - 1
        d, total, given = levels[k]
        lower = p(gram[1:]) if k else 1 / (len(uni) + 1)
        t = total.get(gram[:-1], 0)
        n = tables[k].get(gram, 0)
        n = n if n >= (least if k else 1) else 0
        return (n - d[min(n, 3)]) / t * (n > 0) + (1 - given.get(gram[:-1], 0) / t) * lower if t else lower

    return [sum(math.log(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) for s in seqs], p, uni


@pytest.mark.parametrize("least", [1, 2])
def test_against_dictionaries(spark, least, monkeypatch):
    r = random.Random(least)
    docs = [" ".join(r.choice("abcdefghijklmnop") * r.choice([1, 1, 2]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    docs += [docs[0], docs[0].upper(), None, "", " \n "]
    monkeypatch.setattr(K, "BUCKET_BYTES", 400)
    monkeypatch.setattr(K, "WORD_BYTES", 400)
    monkeypatch.setattr(K, "HOT", 64)  # some words are spread, others aren't
    rows = K.lm_scores(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS file"), least).collect()
    got = {x.doc_id: x for x in rows}
    want, p, uni = brute(docs, least)
    assert len(rows) == len(docs)
    for i, w in enumerate(want):
        assert got[i].total_log_prob == pytest.approx(w, abs=1e-6) and got[i].log_prob == pytest.approx(w / (got[i].n_words + 1))
        assert got[i].perplexity == pytest.approx(math.exp(-w / (got[i].n_words + 1)))
    assert all(got[i].log_prob is None and got[i].perplexity is None and got[i].n_words == 0 for i in (62, 63, 64))
    words = [*uni, "unseen"]
    assert sum(p(("a", "b", w)) for w in words) == pytest.approx(1)
    assert K.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pack_round_trip():
    r = np.random.default_rng(1)
    a, b, c = (r.integers(0, m, 5000).astype(np.uint64) << np.uint64(20) for m in (50, 3, 1000))
    x = K.counted(a, b, c, np.ones(5000, np.uint64))
    assert x[3].sum() == 5000
    for p, q in zip(K.unpack(K.pack(*x)), x):
        assert (p == q).all()


def test_many_files(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 3} x y z") for i in range(200)], "doc_id long, text string")
    one = {r.doc_id: r.log_prob for r in K.lm_scores(docs, 1).collect()}
    for name, value in (("BUCKET_BYTES", 100), ("WORD_BYTES", 50), ("HOT", 8), ("FLUSH", 40), ("OPEN", 3)):
        monkeypatch.setattr(K, name, value)
    many = {r.doc_id: r.log_prob for r in K.lm_scores(docs, 1).collect()}
    assert one == pytest.approx(many)


def test_a_word_that_is_a_third_of_all_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(K, "HOT", 256)
    r = random.Random(4)
    docs = ["the " * 300 + "end", " ".join(r.choice(["the", f"w{r.randint(0, 400)}", f"v{r.randint(0, 9)}"]) for _ in range(4000)), "the", None]
    got = {x.doc_id: x.total_log_prob for x in K.lm_scores(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [got[0], got[1], got[2]] == pytest.approx(brute(docs, 1)[0]) and got[3] is None


def test_counts_beyond_a_byte_and_followers_in_a_range():
    x = np.array([0, 254, 255, 256, 10**12])
    small = K.narrow(x)
    assert small[0].tolist() == [0, 254, 255, 255, 255] and K.widen(*small, np.arange(5)).tolist() == x.tolist()
    some, at = K.within(np.array([1, 3, 5, 2, 4], np.uint32), np.array([0, 0, 3, 3, 5]), np.array([3, 3, 5, 5, 5]), np.array([3, 4, 4, 1, 4], np.uint32))
    assert some.tolist() == [0, 2] and at.tolist() == [1, 4]


def test_query_keeps_all_ngrams(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = [r.total_log_prob for r in Q.queries()["op4_lm_scores"](spark, sf).collect() if r.log_prob is not None]
    assert sorted(got) == pytest.approx(sorted(brute(texts, 1)[0]), rel=1e-9)
