"""Schemas of the tables, kinds of edges and symbols, and ranking constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "id string, path string, lang string, text string, preview string, identifiers array<string>, keywords array<string>, symbol_kind string, symbol_name string, "
    "namespace string, containing_type string, span_start int, span_end int, start_line int, end_line int, signature string, xml_links array<string>, def_type string"
)
REFS = "src string, ref_name string, kind string, n long"
EDGES = "src string, dst string, kind string, n long"
VECTORS = "id string, path string, signature string, preview string, identifiers array<string>, vector array<float>"
FILE_STATE = "path string, mtime timestamp"

SYMBOL_KINDS = ("type", "method", "constructor", "property", "field", "def", "namespace")
#: kind, stored code, weight, label when followed forwards, label backwards, shown by uses
EDGE_KINDS = [
    ("Inherits", 3, 2.0, "inherits", "inherited by", True),
    ("Implements", 2, 0.9, "implements", "implemented by", True),
    ("Calls", 1, 0.8, "calls", "called by", True),
    ("References", 2, 0.5, "references", "referenced by", True),
    ("XmlInherits", 10, 1.8, "inherits def", "parent of def", True),
    ("XmlReferences", 4, 0.4, "references def", "referenced by def", True),
    ("XmlBindsClass", 20, 0.7, "binds class", "bound by def", True),
    ("XmlUsesComp", 21, 0.6, "uses component", "component of def", True),
    ("CSharpUsedByDef", 30, 0.7, "used by def", "used in def", False),
]
#: kinds between symbols of code; all others begin or end at a definition
CODE_EDGES = ("Inherits", "Implements", "Calls", "References")
OTHER_WEIGHT = 0.1
RANK_SCALE, IDENTIFIER_BOOST, TEXT_BOOST, SEMANTIC_WEIGHT, BOTH_BONUS = 1e7, 2.5, 1.0, 2.0, 1.0
LEXICAL_K, MAX_RESULTS, PAGE_SIZE, TOOL_PAGE_SIZE = 1000, 20, 30, 50


def edge_kinds(spark: SparkSession) -> DataFrame:
    """The constant table of edge kinds."""
    return spark.createDataFrame(EDGE_KINDS, "kind string, code int, weight double, label_out string, label_in string, uses_visible boolean")


def _lookup(kind: Column, position: int, other) -> Column:
    pairs = [x for row in EDGE_KINDS for x in (F.lit(row[0]), F.lit(row[position]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), other)


def weight(kind: Column) -> Column:
    """A constant map in the expression: no join at all."""
    return _lookup(kind, 2, F.lit(OTHER_WEIGHT))


def label(kind: Column, forwards: bool) -> Column:
    return _lookup(kind, 3 if forwards else 4, kind)


def is_code_edge(kind: Column) -> Column:
    return kind.isin(*CODE_EDGES)


def encode(kind: Column) -> Column:
    """The stored code; 0 for other kinds."""
    return _lookup(kind, 1, F.lit(0))


def decode(code: Column) -> Column:
    """The kind of a stored code; 2 and unknown codes are References."""
    pairs = [x for row in EDGE_KINDS if row[0] != "Implements" for x in (F.lit(row[1]), F.lit(row[0]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit("References"))
