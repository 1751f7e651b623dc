"""Source files to chunks and references; tables in other formats in and out."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import split_identifiers
from . import csharp, xml_defs

GLOB = "*.{[cC][sS],[xX][mM][lL]}"
PARSED = f"chunk struct<{', '.join(f'{n}: {t}' for n, t in (c.split(' ') for c in schema.CHUNKS.split(', ')))}>, refs array<struct<ref_name: string, kind: string>>, alias string, error string"


def base_path(path: str) -> str:
    """Absolute, without extension: what the files of a stored graph are named after."""
    return os.path.abspath(os.path.splitext(path)[0])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, text of all C# and XML files below a folder; an error if there is no such folder."""
    if "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime; the contents aren't read."""
    return scan(spark, root).select("path", "mtime")


def parse_files(files: DataFrame, strict_compat: bool = False, **names) -> DataFrame:
    """chunk, refs, alias, error: one row for each declaration or definition. A file that can't be parsed gives one row with its error and no chunk."""
    fields = [c.split(" ")[0] for c in schema.CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    found = csharp.parse(text, path) if path.lower().endswith(".cs") else xml_defs.parse(text, path, strict_compat, **names)
                    rows += [({k: c[k] for k in fields}, [{"ref_name": n, "kind": k} for n, k in refs], alias, None) for c, refs, alias in found]
                except Exception as e:
                    rows.append((None, None, None, f"{path}: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["chunk", "refs", "alias", "error"])

    return files.select("path", "text").mapInPandas(run, PARSED)


def chunks(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """The chunks, with identifiers split by column expressions."""
    c = parsed.where("chunk IS NOT NULL").select("chunk.*")
    return c.withColumn("identifiers", split_identifiers(F.col("keywords"), compat))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.where("chunk IS NOT NULL").select(F.col("chunk.id").alias("src"), F.explode("refs").alias("r")).select("src", "r.ref_name", "r.kind")


def aliases(parsed: DataFrame) -> DataFrame:
    """symbol_name, id of definitions that have a second name."""
    return parsed.where("alias IS NOT NULL").select(F.col("alias").alias("symbol_name"), F.col("chunk.id").alias("id"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors from JSON lines: malformed lines and those without an id or vector are dropped; of ids that are equal in any case the first by path and id stays."""
    rows = spark.read.schema(schema.VECTORS).option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL AND trim(id) <> '' AND vector IS NOT NULL")
    w = Window.partitionBy(F.lower("id")).orderBy("path", "id")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def write_vectors(vectors: DataFrame, path: str, form: str = "parquet") -> None:
    if form not in ("parquet", "json"):
        raise ValueError("form must be parquet or json")
    getattr(vectors.write.mode("overwrite"), form)(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, score double").option("sep", "\t").csv(path)


def write_ranks(ranks: DataFrame, path: str, digits: int = 6) -> None:
    """id, score with fixed digits, highest first."""
    ranks.orderBy(F.desc("score"), "id").select("id", F.format_string(f"%.{digits}f", "score")).write.mode("overwrite").option("sep", "\t").csv(path)


def read_file_state(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime from a JSON object of milliseconds."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", "map<string, long>")).alias("path", "ms"))
    return entries.select("path", F.timestamp_millis("ms").alias("mtime"))


def file_state_json(state: DataFrame) -> str:
    return json.dumps({r.path: r.ms for r in state.select("path", F.unix_millis("mtime").alias("ms")).collect()}, sort_keys=True)


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Edges twice, sorted by source and by target within files, so that a look-up of either reads few row groups; and nodes and counts. The edges are made once and kept for both orders and their ranges' bounds."""
    from ..operators.pagerank import cut

    edges = cut(edges)
    for column, name in (("src", "edges_out"), ("dst", "edges_in")):
        edges.repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(f"{path}/{name}")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sparkSession.createDataFrame([(nodes.count(), edges.count())], "nodes long, edges long").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def pack_adjacency(magic: bytes, pointers: list[int], indices: list[int], kinds: list[int]) -> bytes:
    """The compressed sparse row format: magic, version 1, nodes, edges, pointers, indices, length, kinds; little-endian."""
    n, e = len(pointers) - 1, len(indices)
    return magic + struct.pack(f"<iii{n + 1}i{e}ii", 1, n, e, *pointers, *indices, len(kinds)) + bytes(kinds)


def unpack_adjacency(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, index and kind of each edge; ValueError for a wrong version or lengths."""
    if len(data) < 16:
        raise ValueError("too short")
    version, n, e = struct.unpack_from("<iii", data, 4)
    if version != 1 or n < 0 or e < 0 or len(data) != 20 + 4 * (n + 1 + e) + e:
        raise ValueError("wrong version or length")
    pointers = np.frombuffer(data, "<i4", n + 1, 16)
    indices = np.frombuffer(data, "<i4", e, 16 + 4 * (n + 1))
    (length,) = struct.unpack_from("<i", data, 16 + 4 * (n + 1 + e))
    if length != e or pointers[-1] != e:
        raise ValueError("lengths disagree")
    kinds = np.frombuffer(data, np.uint8, e, 20 + 4 * (n + 1 + e))
    return np.repeat(np.arange(n), np.diff(pointers)), indices, kinds


def read_adjacency(spark: SparkSession, path: str, nodes_path: str) -> DataFrame:
    """Edges of a stored graph of one binary file and its list of nodes (index, id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                row, index, kind = unpack_adjacency(bytes(content))
                yield pd.DataFrame({"s": row, "d": index, "code": kind.astype(int)})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "s int, d int, code int")
    nodes = spark.read.schema("i int, id string").option("sep", "\t").csv(nodes_path)
    e = raw.join(nodes.select(F.col("i").alias("s"), F.col("id").alias("src")), "s").join(nodes.select(F.col("i").alias("d"), F.col("id").alias("dst")), "d")
    return e.groupBy("src", "dst", schema.decode(F.col("code")).alias("kind")).agg(F.count("*").alias("n"))
