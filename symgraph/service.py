"""JSON-RPC over lines: four tools on an index. It has no logic of its own beyond checking arguments and shaping answers."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import IO, Any

from pyspark.sql import functions as F

from . import schema
from .operators import hybrid, items, navigate, vectors
from .plans.index import Index

PROTOCOL = "2024-11-05"
NOT_FOUND, INVALID, NOT_READY, INTERNAL = -32601, -32602, -32002, -32603


@dataclass
class Tool:
    name: str
    description: str
    properties: dict[str, dict]
    required: list[str]
    run: Callable[[dict], dict]

    def described(self) -> dict:
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": self.properties, "required": self.required}}


class Tools:
    def __init__(self, index: Index, embedder: vectors.Embedder | None = None, api_key: str | None = None):
        """Queries are embedded by what the index was made with, unless another embedder is given."""
        self.index = index
        if embedder is None and index.has("embedder"):
            e = index.table("embedder").first()
            embedder = vectors.query_embedder(e.kind, e.url, e.model, e.dims or 768, api_key) if e.kind != "api" or api_key else None
        self.embed = vectors.QueryCache(embedder) if embedder else None
        text, number = {"type": "string"}, {"type": "integer"}
        page = {"symbol": text, "kind": text, "depth": {**number, "minimum": 1, "maximum": 2}, "page": {**number, "minimum": 1}, "max_results": {**number, "minimum": 1, "maximum": 500}}
        made = [
            Tool("rough_search", "Ranked search in code and definitions", {"query": text, "kind": text, "max_results": {**number, "minimum": 1, "maximum": 100}, "lexical_k": {**number, "minimum": 1}, "semantic_k": {**number, "minimum": 0}}, ["query"], self.rough_search),
            Tool("get_uses", "What a symbol uses", page, ["symbol"], lambda a: self.neighbours(a, "uses")),
            Tool("get_used_by", "What uses a symbol", page, ["symbol"], lambda a: self.neighbours(a, "used_by")),
            Tool("get_item", "A symbol's source", {"symbol": text, "max_lines": {**number, "minimum": 0}}, ["symbol"], self.get_item),
        ]
        self.by_name = {t.name: t for t in made}

    def rough_search(self, a: dict) -> dict:
        began = time.time()
        chunks, has, of = self.index.table("chunks"), self.index.has, self.index.table
        table = of("vectors") if has("vectors") else None
        lexical_k, semantic_k = _int(a, "lexical_k", schema.LEXICAL_K), _int(a, "semantic_k", 0)
        found = hybrid.rough_search_indexed(of("postings"), of("term_stats"), of("field_stats"), _text(a, "query"), table, self.embed, a.get("kind"), _int(a, "max_results", schema.MAX_RESULTS), lexical_k, semantic_k=semantic_k)
        rows = hybrid.search_rows(found, chunks)
        rows = rows.join(self.index.table("nodes"), "id", "left").orderBy(F.desc("score"), "id")
        return {"results": [r.asDict() for r in rows.collect()], "queryTime": f"{time.time() - began:.2f}s"}

    def neighbours(self, a: dict, direction: str) -> dict:
        depth, page, size = _int(a, "depth", 1), _int(a, "page", 1), _int(a, "max_results", schema.TOOL_PAGE_SIZE)
        if depth not in (1, 2) or page < 1 or not 1 <= size <= 500:
            raise ValueError("depth must be 1 or 2, page positive, max_results from 1 to 500")
        nodes = self.index.table("nodes")
        symbol = navigate.resolve(nodes, _text(a, "symbol"))
        if symbol is None:
            return {"symbol": a["symbol"], "edges": [], "message": "no such symbol"}
        edges = self.index.table("edges_out" if direction == "uses" else "edges_in")
        rows = [r.asDict() for r in navigate.query(edges, self.index.table("ranks"), symbol, direction, a.get("kind"), page, size, nodes=nodes, depth=depth).collect()]
        total = rows[0]["total_count"] if rows else 0
        edges_out = [{k: r[k] for k in ("id", "node_id", "kind", "label", "n", "score")} for r in rows]
        return {"symbol": symbol, "edges": edges_out, "pagination": {"page": page, "pageSize": size, "totalCount": total, "totalPages": navigate.pages(total, size), "hasMore": page * size < total}}

    def get_item(self, a: dict) -> dict:
        lines = _int(a, "max_lines", 0)
        if lines < 0:
            raise ValueError("max_lines must not be negative")
        wanted = _text(a, "symbol")
        chunks = self.index.table("chunks")
        symbol = navigate.resolve(self.index.table("nodes"), wanted)
        row = items.item(items.find(chunks, symbol or wanted), lines).first()
        if row is None:
            return {"symbol": wanted, "message": "no such symbol"}
        keep = ("id", "path", "lang", "symbol_kind", "namespace", "containing_type", "signature", "start_line", "end_line", "total_lines", "shown_lines", "truncated", "text")
        return {k: row[k] for k in keep}


def _text(a: dict, name: str) -> str:
    v = a.get(name)
    if not isinstance(v, str) or not v.strip():
        raise ValueError(f"{name} must be a text that isn't empty")
    return v


def _int(a: dict, name: str, default: int) -> int:
    v = a.get(name, default)
    if not isinstance(v, int) or isinstance(v, bool):
        raise ValueError(f"{name} must be an integer")
    return v


class Server:
    def __init__(self, tools: Tools):
        self.tools, self.ready, self.over = tools, False, False

    def answer(self, message: Any) -> dict | None:
        """The reply to a message, or none for one without an id."""
        if not isinstance(message, dict) or "id" not in message:
            if isinstance(message, dict) and message.get("method") in ("initialized", "notifications/initialized"):
                self.ready = True
            return None
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": self._call(message.get("method"), message.get("params") or {})}
        except RpcError as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": INTERNAL, "message": f"{type(e).__name__}: {e}"}}

    def _call(self, method: str | None, params: dict) -> Any:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "symgraph", "version": "1"}}
        if method in ("initialized", "notifications/initialized"):
            self.ready = True
            return {}
        if method == "shutdown":
            self.over = True
            return {}
        if method not in ("tools/list", "tools/call"):
            raise RpcError(NOT_FOUND, f"unknown method {method}")
        if not self.ready:
            raise RpcError(NOT_READY, "not initialized")
        if method == "tools/list":
            return {"tools": [t.described() for t in self.tools.by_name.values()]}
        tool = self.tools.by_name.get(params.get("name"))
        if not tool:
            raise RpcError(INVALID, f"unknown tool {params.get('name')}")
        try:
            result = tool.run(params.get("arguments") or {})
        except ValueError as e:
            raise RpcError(INVALID, str(e)) from e
        return {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False, default=str)}]}

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        """One message a line, until shutdown or the end; blank lines are skipped."""
        for line in lines:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
            if self.over:
                return


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def configured(environ: dict[str, str] | None = None, file: str = "symgraph.json") -> str:
    """The index's path: from SYMGRAPH_INDEX, else a JSON file's "index", else a folder named index. An error if there are no chunks there."""
    environ = dict(os.environ) if environ is None else environ
    path = environ.get("SYMGRAPH_INDEX")
    if not path and os.path.exists(file):
        with open(file) as f:
            path = json.load(f).get("index")
    path = path or os.path.abspath("index")
    if "://" not in path and not os.path.isdir(os.path.join(path, "chunks")):
        raise FileNotFoundError(f"no index at {path}")
    return path
