import pytest
from pyspark.sql import functions as F

from symgraph import schema
from symgraph.functions import similarity as S
from symgraph.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "name,words",
    [
        ("CompPropertiesTick", ["comppropertiestick", "comp", "properties", "tick"]),
        ("HTTPServer9Foo", ["httpserver9foo", "http", "server9", "foo"]),
        ("Stage.Pawn, x-y", ["stage.pawn", "stage.", "pawn", "x", "y"]),
        ("   ", []),
    ],
)
def test_split_identifier(spark, name, words):
    assert one(spark, T.split_identifier(F.col("s")), s=name) == words
    again = one(spark, T.split_identifiers(F.array(*(F.lit(w) for w in words))), s=name) if words else []
    assert set(again) <= set(words) | {w.strip(".") for w in words} and all(w == w.lower() and w for w in again)


def test_compat_splits_nothing(spark):
    assert one(spark, T.split_identifier(F.col("s"), compat=True), s="FooBar") == ["foobar"]


def test_preview(spark):
    assert one(spark, T.preview(F.col("s")), s="a" * 321) == "a" * 320 + " …"
    assert one(spark, T.preview(F.col("s")), s=" b\n") == "b"


@pytest.mark.parametrize("value,want", [("Building_Door", True), ("true", False), ("3.5", False), ("a b", False), ("Foo", True), ("Ab", False), ("Stage.X", True), ("", False), ("1e5", False), ("_x.y", True)])
def test_class_names(spark, value, want):
    from symgraph.sources.xml_defs import looks_like_class

    assert one(spark, T.looks_like_class(F.col("s")), s=value) is want
    assert bool(looks_like_class(value)) is want


def test_qualified(spark):
    for name, want in {"CompProperties_Power": "Game.CompProperties_Power", "Verb_Shoot": "Engine.Verb_Shoot", "Foo": "Game.Foo", "A.B": "A.B"}.items():
        assert one(spark, T.qualified_class(F.col("s")), s=name) == want


def test_slices_and_lines(spark):
    assert one(spark, T.text_slice(F.col("s"), F.lit(1), F.lit(3)), s="abcd") == "bc"
    assert one(spark, T.text_slice(F.col("s"), F.lit(1), F.lit(9)), s="abcd") is None
    assert one(spark, T.head_lines(F.col("s"), 2), s="a\nb\nc") == "a\nb"
    assert one(spark, T.embedding_text(F.col("s"), F.lit("p"), "query"), s="  ") == "query: p"


def test_hashes_and_vectors(spark):
    assert one(spark, S.fnv1a(F.col("s")) % 768, s="pawn") == 139
    assert S.hash_vector(["pawn"])[139] == 1
    assert one(spark, S.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11
    assert one(spark, S.dot(F.col("a"), F.col("b")), a=[1.0], b=[3.0, 4.0]) == 0
    assert one(spark, S.l2_normalized(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, S.l2_normalized(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_jaro_winkler():
    assert S.jaro_winkler_value("MARTHA", "MARHTA", True) == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler_value("DIXON", "DICKSONX", True) == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler_value("a", "a") == 1 and S.jaro_winkler_value("a", "b") == 0 and S.jaro_winkler_value("", "b") == 0
    assert S.jaro_winkler_value("Stage.Pawn", "Stage.PawnRenderer", True) == pytest.approx(0.9111, abs=1e-4)


def test_edge_kinds(spark):
    assert one(spark, schema.weight(F.col("k")), k="Calls") == 0.8 and one(spark, schema.weight(F.col("k")), k="?") == 0.1
    assert one(spark, schema.label(F.col("k"), False), k="Calls") == "called by"
    assert one(spark, schema.decode(schema.encode(F.col("k"))), k="Implements") == "References"
