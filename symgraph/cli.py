"""Command line: index, rough-search, get-uses, get-used-by, get-item, serve."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from . import schema
from .operators import vectors
from .plans.index import Index, build
from .service import Server, Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symgraph", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), c.add_argument("--index", default="index"), *(c.add_argument(n, **k) for n, k in args)][0]
    number = lambda default: {"type": int, "default": default}
    add("index", ("--root", {"required": True}), ("--force", {"nargs": "?", "const": "all"}), ("--no-incremental", {"action": "store_true"}), ("--embedding-server", {}), ("--api-url", {}), ("--api-key", {}), ("--model-name", {"default": ""}), ("--resolve", {"choices": ["exact", "suffix"], "default": "exact"}))
    add("rough-search", ("query", {}), ("--kind", {}), ("--max-results", number(schema.MAX_RESULTS)), ("--lexical-k", number(schema.LEXICAL_K)), ("--semantic-k", number(0)), ("--api-key", {}))
    for verb in ("get-uses", "get-used-by"):
        add(verb, ("symbol", {}), ("--kind", {}), ("--page", number(1)), ("--max-results", number(schema.PAGE_SIZE)))
    add("get-item", ("symbol", {}), ("--max-lines", number(0)))
    add("serve", ("--api-key", {}))
    return p


def printed(verb: str, r: dict) -> str:
    if verb == "rough-search":
        return "\n".join(f"{x['score']:.4f} [{x['source']}] {x['id']}\n    {x['title']} ({x['path']}:{x['start_line']})" for x in r["results"])
    if verb in ("get-uses", "get-used-by"):
        g = r.get("pagination", {})
        lines = [f"{x['score']:.2f} {x['label']} ({x['n']}) #{x['node_id']} {x['id']}" for x in r["edges"]]
        return "\n".join([r["symbol"], *lines, f"page {g.get('page', 1)} of {g.get('totalPages', 0)}, {g.get('totalCount', 0)} in all" if g else r.get("message", "")])
    if verb == "get-item":
        return r.get("message") or f"{r['id']} ({r['path']}:{r['start_line']}-{r['end_line']}), {r['shown_lines']} of {r['total_lines']} lines\n{r['text']}"
    return json.dumps(r, indent=2)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("symgraph").getOrCreate()
    path = a.index if "://" in a.index else os.path.abspath(a.index)
    if a.verb == "index":
        api = (a.api_url, a.api_key, a.model_name) if a.api_url and a.api_key else None
        made_by = ("api", a.api_url, a.model_name) if api else ("server", a.embedding_server, "") if a.embedding_server else ("hash", "", "")
        return printed("index", build(spark, a.root, path, not a.no_incremental, a.force, vectors.choose(api, a.embedding_server, vectors.HashEmbedder), made_by, a.resolve))
    tools = Tools(Index(spark, path), api_key=getattr(a, "api_key", None))
    if a.verb == "serve":
        Server(tools).serve()
        return ""
    names = {"query": "query", "symbol": "symbol", "kind": "kind", "page": "page", "max_results": "max_results", "max_lines": "max_lines", "lexical_k": "lexical_k", "semantic_k": "semantic_k"}
    arguments = {n: getattr(a, k) for n, k in names.items() if getattr(a, k, None) is not None}
    return printed(a.verb, tools.by_name[a.verb.replace("-", "_")].run(arguments))


def main() -> None:
    print(run())


if __name__ == "__main__":
    main()
