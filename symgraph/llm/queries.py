"""The queries of this package, each over its whole table with production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .decontaminate import contamination
from .kneser_ney import lm_scores
from .language import identify_language
from .minhash import minhash_near_dedup
from .packing import pack_windows
from .quality import quality_scores
from .secrets import secret_scan
from .suffix_array import suffix_array_dedup
from .suffix_tree import suffix_tree_dedup


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_count=1)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=50)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x00-\x20]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
runs AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h FROM w, LATERAL unnest(range(1, len(ws) - 48)) AS t(i)),
real AS (SELECT h, count(*) AS n FROM runs GROUP BY h HAVING min(doc_id) <> max(doc_id)),
found AS (SELECT doc_id, i - 1 AS s, i + 49 AS e, n FROM runs JOIN real USING (h)),
marked AS (SELECT *, CASE WHEN max(e) OVER before >= s THEN 0 ELSE 1 END AS new FROM found WINDOW before AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, CAST(max(e) - min(s) AS INTEGER) AS n_words, CAST(max(n) AS BIGINT) AS occurrences
FROM numbered GROUP BY doc_id, island
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_decontaminate, op3_suffix_tree_dedup, op4_lm_scores, op5_minhash_near_dedup, op6_nearest_neighbours, op7_packing, op8_quality, op9_language, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": REPEATS_SQL, "op3_suffix_tree_dedup": REPEATS_SQL}
