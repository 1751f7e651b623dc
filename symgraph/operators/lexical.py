"""Inverted index tables and ranked lexical search.

postings(field, term, doc_id, tf), doc_stats(field, doc_id, dl), term_stats(field, term, df), field_stats(field, n_docs, avgdl). A stored
index has the length and language of the document in each posting, so a search reads its own terms' postings (a pushed ``term IN (...)`` on files sorted by
term) and a row of statistics for each of its terms and fields, and is one shuffle by document and a top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """One row for each term of a field of a document. Documents are shuffled by id rather than their words by term, and counted where they are."""
    docs = docs.repartition(id_col)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), words.alias("words")) for name, words in fields.items())))
    words = docs.select(F.col(id_col).alias("doc_id"), each.alias("f")).select("f.field", F.explode("f.words").alias("term"), "doc_id")
    return words.groupBy("field", "term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def index_postings(docs: DataFrame, id_col: str, fields: dict[str, Column], lang_col: str = "lang") -> DataFrame:
    """Postings as they are stored: with dl, the number of words of the field, and the document's lang."""
    docs = docs.repartition(id_col)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.coalesce(words, F.array().cast("array<string>")).alias("words")) for name, words in fields.items())))
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), each.alias("f")).select("f.field", F.explode("f.words").alias("term"), "doc_id", F.size("f.words").alias("dl"), "lang")
    return words.groupBy("field", "term", "doc_id", "dl", "lang").agg(F.count("*").cast("int").alias("tf"))


def field_stats(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, n_docs (all documents), avgdl (of those with a word): a row for each field."""
    sizes = [F.struct(F.lit(name).alias("field"), F.size(words).alias("dl")) for name, words in fields.items()]
    rows = docs.select(F.explode(F.array(*sizes)).alias("f")).select("f.*")
    return rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))


def doc_lengths(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """field, doc_id, dl of documents with a word in the field, without their postings."""
    sizes = F.array(*(F.struct(F.lit(name).alias("field"), F.size(words).cast("long").alias("dl")) for name, words in fields.items()))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(sizes).alias("f")).select("f.field", "doc_id", "f.dl").where("dl > 0")


def doc_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """df by counting rows: a term has one row for each document."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> list[str]:
    words = (w.strip(".") for w in re.split(r"[^\w.]+", query.lower()))
    return sorted({w for w in words if w and w not in STOP_WORDS})


def scores(docs: DataFrame, id_col: str, fields: dict[str, Column], query: str, boosts: dict[str, float] | None = None, similarity: str = "bm25") -> DataFrame:
    """doc_id, score of all documents with a term of the query.

    Fields' words are filtered to the query's terms where they are made, so only matching words are exploded and shuffled. Words are made once, and each
    document's number of them and hits are kept in the shared folder for the statistics and the scores. similarity: bm25, or classic (tf-idf with coordination).
    """
    from .pagerank import cut

    if similarity not in ("bm25", "classic"):
        raise ValueError("similarity must be bm25 or classic")
    boosts = boosts or {}
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    found = lambda name: lambda w: F.struct(F.lit(name).alias("field"), F.lit(float(boosts.get(name, 1.0))).alias("boost"), F.size(w).alias("dl"), F.filter(w, lambda x: x.isin(terms)).alias("hits"))
    each = F.concat(*(F.transform(F.array(w), found(name)) for name, w in fields.items()))  # the lambda binds the words, else they would be made twice
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.explode(each).alias("f")).select("doc_id", "f.*"))
    stats = sized.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
    hits = sized.where(F.size("hits") > 0).select("doc_id", "field", "boost", "dl", F.explode("hits").alias("term"))
    hits = hits.groupBy("doc_id", "field", "boost", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    return score(hits, df, stats, similarity, len(terms) * len(fields))


def score(hits: DataFrame, df: DataFrame, stats: DataFrame, similarity: str, n_clauses: int) -> DataFrame:
    """df has a row for each of the query's terms and stats one for each field: both are bounded by the query, not the data."""
    x = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    if similarity == "bm25":
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        value = F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return x.groupBy("doc_id").agg(F.sum(value).alias("score"))
    idf = 1 + F.log(F.col("n_docs") / (F.col("df") + 1))
    value = F.col("boost") * F.sqrt("tf") * idf * idf / F.sqrt("dl")
    return x.groupBy("doc_id").agg((F.sum(value) * F.count("*") / n_clauses).alias("score"))


def scores_from_index(posted: DataFrame, terms_table: DataFrame, fields_table: DataFrame, query: str, boosts: dict[str, float], similarity: str = "bm25") -> DataFrame:
    """The same from stored tables: index_postings, term_stats and field_stats. Further conditions on the postings (a language) leave the statistics as they are."""
    if similarity not in ("bm25", "classic"):
        raise ValueError("similarity must be bm25 or classic")
    terms, fields = query_terms(query), sorted(boosts)
    asked = F.col("term").isin(terms) & F.col("field").isin(fields)
    boost = F.element_at(F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))]), F.col("field"))
    hits = posted.where(asked).select("doc_id", "field", boost.alias("boost"), "dl", "term", "tf")
    return score(hits, terms_table.where(asked), fields_table.where(F.col("field").isin(fields)), similarity, len(terms) * len(fields))


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """TakeOrderedAndProject, with the id as tie-break."""
    return scored.orderBy(F.desc(score_col), F.asc(id_col)).limit(k)
