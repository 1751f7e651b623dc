"""Two-stage search: lexical candidates, then vectors; and their hybrid score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import preview, tokens
from . import lexical, vectors


#: what a query's kind means as a language of chunks
KINDS = {"csharp": "csharp", "cs": "csharp", "def": "xml", "xml": "xml"}


def language_filter(rows: DataFrame, kind: str | None, column: str = "lang", codes: dict[str, str] = KINDS) -> DataFrame:
    """Rows of a kind's language, in any case; a kind that isn't among the codes doesn't filter. On a table partitioned by language it prunes partitions."""
    lang = codes.get((kind or "").lower())
    return rows.where(F.col(column) == lang) if lang else rows


def merged(lex: DataFrame, sem: DataFrame) -> DataFrame:
    """id, lexical, semantic, score, source of both rankings, joined on lower-case ids. Each score is relative to its greatest; both are bounded by their k."""
    a = lex.select(F.lower(F.col("id").cast("string")).alias("key"), F.col("id").alias("lex_id"), F.col("score").alias("lexical"))
    b = sem.select(F.lower(F.col("id").cast("string")).alias("key"), F.col("id").alias("sem_id"), F.col("score").alias("semantic"))
    x = a.join(b, "key", "full_outer")
    whole = Window.partitionBy(F.lit(1))  # at most k rows of each side
    part = lambda c: F.coalesce(F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)), F.lit(0.0))
    both = F.col("lexical").isNotNull() & F.col("semantic").isNotNull()
    value = part("lexical") + schema.SEMANTIC_WEIGHT * part("semantic") + F.when(both, schema.BOTH_BONUS).otherwise(0.0)
    source = F.when(both, "mixed").when(F.col("lexical").isNotNull(), "lexical").otherwise("semantic")
    return x.select(F.coalesce("lex_id", "sem_id").alias("id"), "lexical", "semantic", value.alias("score"), source.alias("source"))


def semantic_only(sem: DataFrame) -> DataFrame:
    """id, score relative to the greatest, source."""
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    return sem.select("id", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)).alias("score"), F.lit("semantic").alias("source"))


def check(max_results: int, lexical_k: int) -> None:
    if not 1 <= max_results <= 100:
        raise ValueError("max_results must be from 1 to 100")
    if lexical_k < 1:
        raise ValueError("lexical_k must be positive")


BOOSTS = {"symbol_id": schema.IDENTIFIER_BOOST, "text": schema.TEXT_BOOST}


def rough_search(
    chunks: DataFrame, query: str, vectors_table: DataFrame | None = None, embedder: Callable[[str], Sequence[float] | None] | None = None, kind: str | None = None, max_results: int = schema.MAX_RESULTS, lexical_k: int = schema.LEXICAL_K,
    similarity: str = "bm25", use_semantic_only: bool = True, strict_compat: bool = False, on_embed_error: str = "raise", id_col: str = "id", id_words: Column | None = None, text_words: Column | None = None, semantic_k: int | None = None,
) -> DataFrame:
    """id, score, source: lexical top ``lexical_k``, of these the ``max_results`` (or ``semantic_k``, if more) nearest to the query's vector.

    Without an embedder, a query vector or a vector table the lexical ranking is the answer (none with strict_compat). on_embed_error: raise, or lexical;
    a query vector of another length than the table's is such an error. A kind takes hits of a language; statistics are of all chunks.
    """
    check(max_results, lexical_k)
    fields = {"symbol_id": F.array_distinct(tokens(F.col(id_col).cast("string"))) if id_words is None else id_words, "text": tokens(F.col("text")) if text_words is None else text_words}
    found = lexical.scores(chunks, id_col, fields, query, BOOSTS, similarity)
    if (kind or "").lower() in KINDS:
        found = found.join(language_filter(chunks, kind).select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    return _ranked(found, query, vectors_table, embedder, max_results, lexical_k, use_semantic_only, strict_compat, on_embed_error, semantic_k)


def rough_search_indexed(
    posted: DataFrame, terms_table: DataFrame, fields_table: DataFrame, query: str, vectors_table: DataFrame | None = None, embedder: Callable[[str], Sequence[float] | None] | None = None, kind: str | None = None, max_results: int = schema.MAX_RESULTS, lexical_k: int = schema.LEXICAL_K,
    similarity: str = "bm25", use_semantic_only: bool = True, strict_compat: bool = False, on_embed_error: str = "raise", semantic_k: int | None = None, boosts: dict[str, float] | None = None,
) -> DataFrame:
    """The same from the stored index, of which only the query's terms are read."""
    check(max_results, lexical_k)
    found = lexical.scores_from_index(language_filter(posted, kind), terms_table, fields_table, query, boosts or BOOSTS, similarity)
    return _ranked(found, query, vectors_table, embedder, max_results, lexical_k, use_semantic_only, strict_compat, on_embed_error, semantic_k)


def _ranked(found: DataFrame, query: str, vectors_table: DataFrame | None, embedder, max_results: int, lexical_k: int, use_semantic_only: bool, strict_compat: bool, on_embed_error: str, semantic_k: int | None) -> DataFrame:
    if not query.strip():
        raise ValueError("query must not be empty")
    lex = lexical.top_k(found, lexical_k).withColumnRenamed("doc_id", "id")
    vector, length = None, None
    if embedder and vectors_table is not None:
        first = vectors_table.select(F.size("vector").alias("n")).first()
        length = first.n if first else None
        try:
            vector = embedder(query)
            if vector is not None and length not in (None, len(vector)):
                raise vectors.EmbeddingError(f"the query's vector has {len(vector)} elements, those of the index {length}: they are of different embedders")
        except Exception as e:
            vector = None
            if on_embed_error != "lexical":
                raise vectors.EmbeddingError(f"the query can't be embedded: {e}") from e
    plain = lex.orderBy(F.desc("score"), F.asc("id")).limit(max_results).withColumn("source", F.lit("lexical"))
    if vector is None or vectors_table is None or length is None:
        return plain.limit(0) if strict_compat else plain
    sem = vectors.top_k(vectors_table, vector, max(max_results, semantic_k or 0), candidates=lex.select("id"))
    out = semantic_only(sem) if use_semantic_only else merged(lex, sem).select("id", "score", "source")
    return out.orderBy(F.desc("score"), F.asc("id")).limit(max_results)


def search_rows(found: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Results with what a reader sees: title (first line of signature, preview or id), rounded score, path, preview (for defs). Rows without a path are dropped."""
    c = chunks.select(F.col(id_col).alias("id"), "path", "lang", "signature", F.col("preview").alias("shown"), "symbol_kind", "namespace", "start_line", "end_line")
    nonblank = lambda x: F.nullif(F.trim(x), F.lit(""))
    title = F.split(F.coalesce(nonblank(F.col("signature")), nonblank(F.col("shown")), F.col("id")), "\n")[0]
    out = c.join(F.broadcast(found), "id").where(F.trim("path") != "")  # at most max_results rows
    return out.select("id", title.alias("title"), F.bround("score", 4).alias("score"), "source", "path", "lang", "symbol_kind", "namespace", "start_line", "end_line", F.when(F.col("lang") == "csharp", "").otherwise(preview(F.col("shown"), 200)).alias("preview"))
