import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from symgraph.llm import shared
from symgraph.llm.shared import free_name, without, without_repeats, written


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.schema, []
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns.names, name
        kept.append(docs.count())
    assert 200 >= kept[0] >= 195 and kept[0] > kept[1] > kept[2] == kept[3]
    rows = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, rows))


def test_decisions(spark, sf):
    text = " ".join(f"word{i} and the of" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = spark.createDataFrame(
        [(1, text, "en", "a", 5), (2, text, "en", "b", 5), (1, text, "en", "a", 5), (None, "the and of", None, None, None), (3, f"before {item} after", "en", "s", 3), (4, None, "en", "s", None), (5, 'the of token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" and', "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    ids = lambda d: sorted((r.doc_id for r in d.collect()), key=str)
    a = P.language(spark, docs, sf)
    assert ids(a) == [1, 1, 2, 3, 5, None]
    b = P.near_duplicates(spark, a, sf)
    assert ids(b) == [1, 3, 5, None]
    c = P.benchmark(spark, b, sf)
    assert ids(c) == [1, 5, None]
    d = P.secrets(spark, c, sf)
    five = d.where("doc_id = 5").first()
    assert five.text == 'the of token = "[SECRET]" and' and five.n_chars == len(five.text)
    assert {r.doc_id for r in P.packing(spark, d, sf).collect()} == {1, 5, None}
    assert P.packing(spark, d.limit(0), sf).count() == 0


#: names that the stages might use themselves
CLASHES = ["__copy", "__bad", "__share", "__letters", "__language", "__confidence", "__n_words", "__n_switches", "language_of", "unwanted", "repeated", "key_of_0", "of", "share", "language", "band", "a", "b", "group_id", "item_id", "want", "length", "piece", "h", "count", "x y"]


def test_stages_on_awkward_rows(spark, sf):
    """Clashing names, nested and map columns, a length that is no number, nulls, repeated rows, an id with two texts, a very long text, no rows."""
    text = " ".join(f"word{i} and the of" for i in range(60))
    rows = [(1, text, "en", "a", "5"), (1, text, "en", "a", "5"), (1, text, "en", "b", "5"), (2, text, "en", "a", "5"), (None, text + " x", "en", None, None), (None, text + " x", "en", None, None), (3, None, "en", "s", "0"), (4, "", None, "s", "0"), (6, "the and of " * 150_000, "en", "s", "1"), (7, "solely", "en", "s", "1"), (7, "the and of it", None, "s", "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars string")
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)), F.expr("named_struct('a b', 1, 'c', array(2)) AS `nested col`"), F.expr("map('k', source) AS m"))
    for _, stage in P.STAGES[:-1]:
        plain, more = stage(spark, docs, sf), stage(spark, odd, sf)
        assert more.schema == odd.schema
        key = lambda r: str(r[:5])
        assert sorted(map(key, more.collect())) == sorted(map(key, plain.collect()))
        assert stage(spark, odd.limit(0), sf).collect() == []
    kept = [r[:4] for r in P.near_duplicates(spark, odd, sf).collect()]
    assert sorted(kept, key=str) == sorted({r[:4] for r in rows if r[0] != 2}, key=str)
    assert sorted(r[:4] for r in P.language(spark, odd, sf).where("doc_id IS NOT NULL").collect())[:3] == [r[:4] for r in rows[:3]]
    secret = docs.withColumn("text", F.lit('the of token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" and'))
    assert {(r.text, r.n_chars) for r in P.secrets(spark, secret, sf).collect()} == {('the of token = "[SECRET]" and', n) for n in ("5", "0", "1", None)}
    assert P.packing(spark, odd, sf).columns == P.packing(spark, docs, sf).columns and P.packing(spark, odd.limit(0), sf).collect() == []


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_that_go_and_rows_that_repeat(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "BROADCAST_IDS", limit)
    rows = [(1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "a", 1), (None, "a", 1), (None, "a", 1), (None, None, None), (3, None, None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, unwanted int")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "doc_id long")
    show = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert show(without(docs, ids, "doc_id", limit)) == sorted((r for r in rows if r[0] != 2), key=str)
    assert show(without_repeats(docs, "doc_id")) == sorted(set(rows), key=str)
    assert without(docs, ids.limit(0), "doc_id", limit).count() == 9 and without_repeats(docs.limit(0), "doc_id").collect() == []
    assert free_name(docs, "Text") == "_Text" and free_name(docs, "other") == "other"
