"""Embeddings: hash embedder, exact top-k by dot product, and pluggable embedders in Arrow batches."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import dot, fnv1a_words, hash_vector
from ..functions.text import CAMEL, embedding_text


class Embedder(Protocol):
    """Made on the workers: texts in, vectors out (None where there is nothing to embed)."""

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class EmbeddingError(RuntimeError):
    """An embedder failed, or gave another number of vectors than texts."""


def hash_embed(docs: DataFrame, id_col: str, words: Column, dims: int = 768) -> DataFrame:
    """id, vector: counts of the words in FNV buckets, normalised. Words that occur several times count as often; rows of one id are added up.

    Words are hashed and counted by Arrow batches of documents, and only the buckets' counts are shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lists = lists.filter(lists.is_valid()) if (kept := batch.filter(lists.is_valid())).num_rows < batch.num_rows else lists
            coded = lists.flatten().dictionary_encode()
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            of = fnv1a_words(coded.dictionary.to_pylist()) % dims
            cells, k = np.unique(rows * dims + of[coded.indices.to_numpy()], return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(lists) + 1) * dims).astype(np.int32)
            part = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            out = pa.record_batch({"id": kept.column(0), "buckets": part(cells % dims), "k": part(k)})
            yield out.filter(pa.array(ends[1:] > ends[:-1]))

    @F.pandas_udf("array<float>")
    def dense(buckets: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for b, k in zip(buckets, values):
            v = np.bincount(np.concatenate(list(b)), np.concatenate(list(k)), dims)
            out.append(v / np.sqrt((v**2).sum()))
        return pd.Series(out)

    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    rows = rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, buckets array<int>, k array<int>")
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("buckets", "k")).alias("e"))
    return lists.select("id", dense(F.col("e.buckets"), F.col("e.k")).alias("vector"))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector", candidates: DataFrame | None = None, candidate_limit: int = 100_000) -> DataFrame:
    """id, score: the k greatest dot products; vectors of another length are left out.

    candidates: (id) to choose from, by a semi-join on lower-case ids; broadcast if there are at most candidate_limit.
    """
    rows = vectors.where(F.size(vector_col) == len(query))
    if candidates is not None:
        wanted = candidates.select(F.lower(F.col(candidates.columns[0]).cast("string")).alias("__id")).distinct()
        if wanted.limit(candidate_limit + 1).count() <= candidate_limit:
            wanted = F.broadcast(wanted)
        rows = rows.join(wanted, F.lower(F.col(id_col).cast("string")) == F.col("__id"), "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col).alias("id"), dot(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)


def embed(chunks: DataFrame, make: Callable[[], Embedder], id_col: str = "id", text_col: str = "text", preview_col: str = "preview", mode: str = "passage", batch: int = 256) -> DataFrame:
    """id, vector by an embedder that each task makes once. A batch with another number of vectors than texts is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                out = embedder(part["t"].tolist())
                if len(out) != len(part):
                    raise EmbeddingError(f"{len(out)} vectors for {len(part)} texts")
                yield pd.DataFrame({"id": part["id"], "vector": out})

    rows = chunks.select(F.col(id_col).cast("string").alias("id"), embedding_text(F.col(text_col), F.col(preview_col), mode).alias("t"))
    return rows.mapInPandas(run, "id string, vector array<float>")


class HashEmbedder:
    """The default without a model: hash vectors of blank-separated words, without the mark of passages; with query, of identifiers' words too."""

    def __init__(self, dims: int = 768, query: bool = False):
        self.dims, self.query = dims, query

    def words(self, text: str) -> list[str]:
        if not self.query:
            return text.removeprefix("passage:").lower().split()
        words = []
        for w in re.sub(r"[^\w.]", " ", text.removeprefix("query:")).split():
            parts = [p.lower() for p in re.split(CAMEL, w) if p]
            words += [w.lower(), *(p for p in parts if p != w.lower())]
        return words

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]:
        return [hash_vector(self.words(t), self.dims).tolist() if t.strip() else None for t in texts]


class HttpEmbedder:
    """A client of an embedding server: POST {mode, items: [{text, preview}]}, answer {vectors}."""

    def __init__(self, url: str, mode: str = "passage", timeout: float = 120):
        self.url, self.mode, self.timeout = url.rstrip("/"), mode, timeout

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/health", timeout=5) as r:
                return r.status == 200
        except OSError:
            return False

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]:
        body = json.dumps({"mode": self.mode, "items": [{"text": t, "preview": t} for t in texts]}).encode()
        request = urllib.request.Request(f"{self.url}/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)["vectors"]


class ApiEmbedder:
    """A client of a remote embedding API (POST {model, input}), in batches, with retries that wait 2**n seconds or as told."""

    def __init__(self, url: str, key: str, model: str, batch: int = 32, retries: int = 3, pause: float = 0.1, sleep: Callable[[float], None] = time.sleep):
        self.url, self.key, self.model, self.batch, self.retries, self.pause, self.sleep = url, key, model, batch, retries, pause, sleep

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for lo in range(0, len(texts), self.batch):
            if lo:
                self.sleep(self.pause)
            out += self._post(list(texts[lo : lo + self.batch]))
        return out

    def _post(self, texts: list[str]) -> list[list[float] | None]:
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    return [d["embedding"] for d in sorted(json.load(r)["data"], key=lambda d: d.get("index", 0))]
            except urllib.error.HTTPError as e:
                if attempt == self.retries or e.code not in (429, 500, 502, 503):
                    raise EmbeddingError(f"status {e.code}") from e
                self.sleep(float(e.headers.get("Retry-After") or 2**attempt))
        raise EmbeddingError("unreachable")


def query_embedder(kind: str, url: str = "", model: str = "", dims: int = 768, key: str | None = None) -> Embedder:
    """For queries, the embedder that an index was made with: hash, server, or api (whose key isn't stored)."""
    if kind == "server":
        return HttpEmbedder(url, "query")
    if kind == "api":
        if not key:
            raise EmbeddingError("the index was made by an API; its key is needed to embed queries")
        return ApiEmbedder(url, key, model)
    return HashEmbedder(dims, query=True)


def choose(api: tuple[str, str, str] | None = None, server: str | None = None, local: Callable[[], Embedder] | None = None) -> Callable[[], Embedder] | None:
    """API, then server, then a local model, or none."""
    if api:
        return lambda: ApiEmbedder(*api)
    if server:
        return lambda: HttpEmbedder(server)
    return local


class QueryCache:
    """A least-recently-used cache of query vectors on the driver, by the query in any case."""

    def __init__(self, embedder: Embedder, size: int = 100):
        self.embedder, self.size, self.kept = embedder, max(1, size), OrderedDict()

    def __call__(self, query: str) -> list[float] | None:
        key = query.lower()
        if key not in self.kept:
            self.kept[key] = self.embedder([query])[0]
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]
