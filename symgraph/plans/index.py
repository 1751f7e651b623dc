"""The index as tables: chunks, postings, vectors, edges and ranks, from one scan of the files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import tokens
from ..operators import graph, incremental, lexical, vectors
from ..operators.pagerank import pagerank
from ..sources import files

TABLES = {"lexical": ("postings", "term_stats", "field_stats"), "vectors": ("vectors", "embedder"), "graph": ("edges_out", "edges_in", "nodes", "ranks")}


def fields() -> dict[str, Column]:
    """Of the lexical index: words of the id and the text; identifiers' words as they are; whole values of the rest."""
    links, kind = F.array(F.array_join("xml_links", ",")), F.array("def_type")
    return {
        "symbol_id": F.array_distinct(tokens(F.col("id"))), "text": tokens(F.col("text")), "identifiers": F.col("identifiers"), "identifiers_kw": F.col("keywords"), "xml_links": F.when(F.size("xml_links") > 0, links), "def_type": F.when(F.trim("def_type") != "", kind)
    }


@dataclass
class Index:
    """Where the tables are; each is read when it is asked for."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def put(self, df: DataFrame, name: str, *partition: str) -> DataFrame:
        """Written beside, then moved into place, so a table may be made from itself."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        df.write.mode("overwrite").partitionBy(*partition).parquet(f"{self.path}/_{name}")
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}{name}") for p in ("_", ""))
        fs = new.getFileSystem(conf)
        fs.delete(old, True)
        fs.rename(new, old)
        return self.table(name)

    def missing(self) -> set[str]:
        return {part for part, names in TABLES.items() if not all(map(self.has, names))}


def edges_of(chunks: DataFrame, refs: DataFrame, aliases: DataFrame | None = None, mode: str = "exact", strict_compat: bool = False) -> DataFrame:
    """All edges: code to code by name; definitions to classes by id; definitions to definitions by name; and back from classes to definitions.

    strict_compat: no edges between definitions.
    """
    code = chunks.where("lang = 'csharp'")
    defs = chunks.where("lang = 'xml'").select("id", "symbol_name")
    defs = defs.unionByName(aliases.select("id", "symbol_name")) if aliases is not None else defs
    plain = graph.resolve(refs.where(F.col("kind").isin("Inherits", "Implements", "Calls", "References")), code, mode)
    interfaces = code.where("symbol_kind = 'type' AND text RLIKE '\\\\binterface\\\\s'").where(F.regexp_extract("text", r"\b(class|struct|interface|record|enum)\s", 1) == "interface")
    plain = graph.classified_bases(plain, interfaces)
    bound = graph.bound(refs.where(F.col("kind").isin("XmlBindsClass", "XmlUsesComp")), code.where("symbol_kind = 'type'"))
    out = [plain, bound, graph.reverse_bindings(bound)]
    if not strict_compat:
        out.append(graph.resolve(graph.valid_references(refs.where(F.col("kind").isin("XmlInherits", "XmlReferences")), defs), defs))
    return graph.valid(graph.union(*out), chunks)


def build(spark: SparkSession, root: str, path: str, incremental_run: bool = True, force: str | None = None, embedder=vectors.HashEmbedder, made_by: tuple[str, str, str] = ("hash", "", ""), mode: str = "exact", strict_compat: bool = False, **names) -> dict:
    """Bring the index of a folder up to date; what was done: changed and deleted files, and the parts made again.

    made_by: kind (hash, server, api), address and model of the embedder, stored so that queries are embedded alike.

    Only changed files are parsed; chunks and references of changed and deleted files are replaced. Vectors are made for chunks whose text is new.
    """
    index = Index(spark, path)
    incremental_run = incremental_run and index.has("file_state")
    listed = files.listing(spark, root).persist(StorageLevel.MEMORY_AND_DISK)
    known = index.table("file_state") if index.has("file_state") else spark.createDataFrame([], "path string, mtime timestamp")
    changes = incremental.changed(listed, known, incremental_run).persist(StorageLevel.MEMORY_AND_DISK)
    gone = incremental.deleted(listed, known).persist(StorageLevel.MEMORY_AND_DISK)
    n_changed, n_gone = changes.count(), gone.count()
    parts = incremental.to_rebuild(changes.unionByName(gone), index.missing(), force)
    if n_changed or n_gone:
        parsed = files.parse_files(files.scan(spark, root).join(changes.select("path"), "path", "left_semi"), strict_compat, **names).persist(StorageLevel.MEMORY_AND_DISK)
        touched = changes.select("path").union(gone.select("path"))
        fresh = {"chunks": files.chunks(parsed, strict_compat), "refs": parsed.where("chunk IS NOT NULL").select(F.col("chunk.path").alias("path"), F.col("chunk.id").alias("src"), F.explode("refs").alias("r")).select("path", "src", "r.ref_name", "r.kind"), "aliases": parsed.where("alias IS NOT NULL").select(F.col("chunk.path").alias("path"), F.col("alias").alias("symbol_name"), F.col("chunk.id").alias("id"))}
        for name, rows in fresh.items():
            old = index.table(name).join(touched, "path", "left_anti").unionByName(rows) if incremental_run and index.has(name) else rows
            index.put(old, name, *(("lang",) if name == "chunks" else ()))
        failed = parsed.where("error IS NOT NULL").select("error")
        errors = [r.error for r in failed.limit(100).collect()]
        if len(errors) == 100 and (more := failed.count() - 100):
            errors.append(f"and {more} more")
        index.put(listed, "file_state")
        parsed.unpersist()
    else:
        errors = []
    chunks = graph.first_of_each(index.table("chunks"), F.col("id"), [F.col("path"), F.col("span_start")])
    if "lexical" in parts:
        posted = lexical.index_postings(chunks, "id", fields())
        posted = index.put(posted.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "postings", "field")
        index.put(lexical.term_stats(posted).repartitionByRange("field", "term").sortWithinPartitions("field", "term"), "term_stats", "field")
        index.put(lexical.field_stats(chunks, fields()), "field_stats")
    if "vectors" in parts and embedder is not None:
        hashed = chunks.withColumn("hash", F.sha2(F.concat_ws("\0", "text", "preview"), 256))
        kept = index.table("vectors").join(hashed.select("id", "hash"), ["id", "hash"], "left_semi") if index.has("vectors") and force is None else None
        todo = hashed.join(kept.select("id"), "id", "left_anti") if kept is not None else hashed
        new = vectors.embed(todo, embedder).where("vector IS NOT NULL").join(todo.select("id", "hash"), "id").select("id", "hash", "vector")
        index.put(kept.select("id", "hash", "vector").unionByName(new) if kept is not None else new, "vectors")
        first = index.table("vectors").select(F.size("vector").alias("n")).first()
        index.put(spark.createDataFrame([(*made_by, first.n if first else 0)], "kind string, url string, model string, dims int"), "embedder")
    if "graph" in parts:
        e = edges_of(chunks, index.table("refs").drop("path"), index.table("aliases"), mode, strict_compat)
        nodes = graph.node_index(chunks)
        files.write_graph(e, nodes, path)
        index.put(pagerank(index.table("nodes"), index.table("edges_out")), "ranks")
    for t in (listed, changes, gone):
        t.unpersist()
    return {"changed": n_changed, "deleted": n_gone, "rebuilt": sorted(parts), "errors": errors}
