"""From raw documents to packed windows of tokens, in five stages.

Each stage works on all that the one before it kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgraph.llm.decontaminate import decontaminated
from symgraph.llm.language import in_a_language
from symgraph.llm.minhash import minhash_near_dedup
from symgraph.llm.packing import pack_windows
from symgraph.llm.secrets import redacted
from symgraph.llm.shared import without, without_repeats, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which enough words are in one of the labelled languages.

    Null, empty and letterless texts go. Rows without an id or a language are judged by their texts; repeated rows stay repeated. Texts of any
    length are read whole. Other columns, whatever their names, stay as they are. An empty table gives none.
    """
    return in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id.

    Rows with one id are one document: all of its rows stay or go, but rows that are equal in every column are one. Rows without an
    id, and those without a text or words, are near duplicates of nothing. Texts of any length are compared whole. Other columns, whatever
    their names, stay as they are. An empty table gives none.
    """
    groups = minhash_near_dedup(docs)
    return without_repeats(without(docs, groups.where("doc_id <> group_id").select("doc_id"), "doc_id"), "doc_id")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and rows without an id stay. If one of several rows with an id has a passage, all of them go; repeated rows stay
    repeated. Texts of any length are read whole. Other columns, whatever their names, stay as they are. An empty table on either side
    takes nothing away.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars put right.

    Null and empty texts, rows without an id and repeated rows stay. n_chars of another type than an integer stays as it is, as do other
    columns, whatever their names. Texts of any length are read whole. An empty table gives none.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: see pack_windows, which says what becomes of nulls, empty and long texts, ties, repeated rows and other columns."""
    return pack_windows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("packing", packing),
]
#: SQL can express neither the models nor the searches of the stages; tests/llm compare them with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
