import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
import math

import pytest
from pyspark.sql import functions as F

from symgraph import cli
from symgraph.operators import graph, hybrid, incremental, items, lexical, navigate, vectors
from symgraph.operators.pagerank import pagerank
from symgraph.plans.index import Index, build
from symgraph.service import Server, Tools, configured
from symgraph.streaming.watch import watch

from test_sources import CODE, DEFS

PAWN = "namespace Engine { public class Pawn : Thing { public void Tick() { Door.Open(); Log(); } void Log() { } } public interface IThing { } public class Thing : IThing { } }"


@pytest.fixture(scope="module")
def triangle(spark):
    e = spark.createDataFrame([("A", "B", "Calls", 2), ("A", "C", "References", 1), ("B", "C", "Calls", 1)], "src string, dst string, kind string, n long")
    return spark.createDataFrame([("A",), ("B",), ("C",)], "id string"), e


def test_pagerank(spark, triangle):
    got = {r.id: r.score for r in pagerank(*triangle).collect()}
    assert got == pytest.approx({"A": 0.192988161, "B": 0.302348036, "C": 0.504663803}, abs=1e-6) and sum(got.values()) == pytest.approx(1, abs=1e-9)
    assert pagerank(triangle[0].limit(0), triangle[1]).collect() == []


def test_neighbours(spark, triangle):
    ranks = pagerank(*triangle)
    rows = navigate.query(triangle[1], ranks, "A", name_similarity=False).collect()
    assert [(r.id, r.kind, r.n, r.total_count) for r in rows] == [("B", "Calls", 2, 2), ("C", "References", 1, 2)]
    assert rows[0].score == pytest.approx(0.302348036e7 * 0.8 * math.sqrt(2), rel=1e-5) and rows[1].score == pytest.approx(0.504663803e7 * 0.5, rel=1e-5)
    assert [r.id for r in navigate.query(triangle[1], ranks, "A", page=2, size=1, name_similarity=False).collect()] == ["C"]
    assert {(r.id, r.kind) for r in navigate.query(triangle[1], ranks, "C", "used_by").collect()} == {("A", "References"), ("B", "Calls")}
    pages = [r.id for p in (1, 2, 3) for r in navigate.query(triangle[1], ranks, "A", page=p, size=1).collect()]
    assert sorted(pages) == ["B", "C"]
    assert {(r.id, r.distance) for r in navigate.n_hop(triangle[1], "C", "used_by", 3).collect()} == {("A", 1), ("B", 1)}
    for bad in ({"page": 0}, {"size": 501}, {"direction": "x"}):
        with pytest.raises(ValueError):
            navigate.query(triangle[1], ranks, "A", **bad)


def test_resolution(spark):
    refs = spark.createDataFrame([("s", "door", "Calls"), ("s", "Door", "Calls"), ("s", "x.Door", "Calls"), ("s", "None", "Calls")], "src string, ref_name string, kind string")
    symbols = spark.createDataFrame([("N.Door", "Door", "type"), ("N.Door()", "Door", "constructor")], "id string, symbol_name string, symbol_kind string")
    edges = lambda **k: {tuple(r) for r in graph.resolve(refs, symbols, **k).collect()}
    assert edges() == {("s", "N.Door", "Calls", 2), ("s", "N.Door()", "Calls", 2)}
    assert edges(mode="suffix") == {("s", "N.Door", "Calls", 3), ("s", "N.Door()", "Calls", 3)}
    assert edges(kinds={"Calls": ["type"]}) == {("s", "N.Door", "Calls", 2)}
    keys = spark.createDataFrame([("a.b.Door",), ("b.Door",), ("xb.Door",)], "key string")
    assert {tuple(r) for r in graph.resolve_suffix_names(refs.withColumn("ref_name", F.lit("b.door")).limit(1), keys).collect()} == set()
    assert {r.key for r in graph.resolve_suffix_names(refs.where("ref_name = 'x.Door'").withColumn("ref_name", F.lit("B.Door")), keys.where("key <> 'b.Door'")).collect()} == {"a.b.Door"}


def test_linkable_fields(spark):
    e = spark.createDataFrame([("ThingDef", "Def", "Inherits", 1), ("Comp", "Base", "Inherits", 1), ("Fast", "Comp", "Inherits", 1)], "src string, dst string, kind string, n long")
    f = spark.createDataFrame([("ThingDef", "a", "Fast"), ("ThingDef", "b", "List<Comp>"), ("ThingDef", "c", "int"), ("ThingDef", "d", "Type"), ("Other", "e", "Fast")], "owner string, name string, type string")
    assert {r.name for r in graph.linkable_fields(f, e, ["Base"], "Def", ("known",)).collect()} == {"a", "b", "d", "known"}


def test_index_scores_equal_direct_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    fields = {"text": F.split(F.lower("text"), " ")}
    posted = lexical.index_postings(docs, "doc_id", fields)
    for similarity in ("bm25", "classic"):
        a = {r.doc_id: r.score for r in lexical.scores(docs, "doc_id", fields, "re of thinor hated", similarity=similarity).collect()}
        b = {r.doc_id: r.score for r in lexical.scores_from_index(posted, lexical.term_stats(posted), lexical.field_stats(docs, fields), "re of thinor hated", {"text": 1.0}, similarity).collect()}
        assert a == pytest.approx(b)
    assert lexical.scores(docs, "doc_id", fields, "the of").collect() == []


class Broken:
    def __call__(self, texts):
        raise OSError("down")


def test_search_fallbacks(spark):
    c = spark.createDataFrame([("N.Pawn", "pawn ticks", "csharp"), ("xml:Gun", "weapon gun pawn", "xml")], "id string, text string, lang string")
    v = spark.createDataFrame([("n.pawn", [1.0, 0.0]), ("xml:gun", [0.5, 0.5])], "id string, vector array<float>")
    found = lambda **k: [(r.id, r.source) for r in hybrid.rough_search(c, "pawn", **k).collect()]
    assert {x for x, _ in found()} == {"N.Pawn", "xml:Gun"} and {s for _, s in found()} == {"lexical"}
    assert found(strict_compat=True) == [] and found(kind="def") == [("xml:Gun", "lexical")]
    up = lambda _: [0.0, 1.0]
    assert found(vectors_table=v, embedder=up) == [("xml:gun", "semantic"), ("n.pawn", "semantic")]
    assert found(vectors_table=v, embedder=up, use_semantic_only=False)[0][1] == "mixed"
    with pytest.raises(vectors.EmbeddingError):
        found(vectors_table=v, embedder=Broken())
    assert len(found(vectors_table=v, embedder=Broken(), on_embed_error="lexical")) == 2
    with pytest.raises(vectors.EmbeddingError, match="different embedders"):
        found(vectors_table=v, embedder=lambda _: [1.0, 0.0, 0.0])
    assert len(found(vectors_table=v, embedder=lambda _: [1.0], on_embed_error="lexical")) == 2
    for bad in (0, 101):
        with pytest.raises(ValueError):
            found(max_results=bad)


def test_query_cache():
    asked = []
    cache = vectors.QueryCache(lambda t: asked.append(t[0]) or [[1.0]], 2)
    for q in ("a", "A", "b", "c", "a"):
        cache(q)
    assert asked == ["a", "b", "c", "a"]


def test_items(spark):
    c = spark.createDataFrame([("Engine.Pawn", "type", "csharp", "a\nb\nc"), ("Engine.Pawn.void Pawn()", "method", "csharp", "x"), ("xml:StoryDef:Cass <- B", "def", "xml", "y")], "id string, symbol_kind string, lang string, text string")
    assert items.find(c, "Other.Pawn").first().id == "Engine.Pawn" and items.find(c, "Pawn").first().id == "Engine.Pawn"
    assert items.find(c, "xml:StoryDef:Cass").first().id == "xml:StoryDef:Cass <- B" and items.find(c, "nothing").count() == 0
    r = items.item(c.where("id = 'Engine.Pawn'"), 2).first()
    assert (r.text, r.total_lines, r.shown_lines, r.truncated) == ("a\nb", 3, 2, True)


def test_rebuild_decision(spark):
    none, some = spark.range(0), spark.range(1)
    assert incremental.to_rebuild(none, set()) == set() and incremental.to_rebuild(some, set()) == {"lexical", "vectors", "graph"}
    assert incremental.to_rebuild(none, {"graph"}) == {"graph"} and incremental.to_rebuild(none, set(), "embed") == {"vectors"} and len(incremental.to_rebuild(none, set(), "")) == 3
    with pytest.raises(ValueError):
        incremental.to_rebuild(none, set(), "what")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("index")
    (root / "a.cs").write_text(CODE.replace("Helper.Log", "Tick"))
    (root / "b.XML").write_text(DEFS)
    (root / "bad.xml").write_text("<Defs><ThingDef>")
    (root / "no.txt").write_text("class X {}")
    return root, out, build(spark, str(root), str(out), default="Demo.Core")


def tables(spark, path):
    index = Index(spark, str(path))
    keys = {"chunks": ["id", "text", "lang"], "edges_out": ["src", "dst", "kind", "n"], "postings": ["field", "term", "doc_id", "tf"], "vectors": ["id"], "nodes": ["node_id", "id"]}
    return {t: sorted(map(tuple, index.table(t).select(*c).collect())) for t, c in keys.items()}


def test_build(spark, indexed):
    root, out, done = indexed
    assert done["changed"] == 3 and len(done["errors"]) == 1 and "bad.xml" in done["errors"][0]
    t = tables(spark, out)
    index = Index(spark, str(out))
    assert index.table("embedder").first().asDict() == {"kind": "hash", "url": "", "model": "", "dims": 768}
    assert {r.field for r in index.table("field_stats").collect()} == {"symbol_id", "text", "identifiers", "identifiers_kw", "xml_links", "def_type"}
    assert index.table("postings").where("field = 'def_type' AND term = 'ThingDef'").count() > 0
    assert len(t["chunks"]) == 8 and len(t["vectors"]) == 8 and [i for i, _ in t["nodes"]] == list(range(8))
    edges = {(s.split(".")[-1], d.split(".")[-1], k): n for s, d, k, n in t["edges_out"]}
    assert edges["Door", "private void Init(int hp)", "Calls"] == 2 and edges["xml:ThingDef:Door <- BaseDoor", "xml:ThingDef:Steel", "XmlReferences"] == 1
    again = build(spark, str(root), str(out), default="Demo.Core")
    assert again == {"changed": 0, "deleted": 0, "rebuilt": [], "errors": []}


def test_incremental_equals_full(spark, indexed, tmp_path):
    root, out, _ = indexed
    (root / "c.cs").write_text(PAWN)
    (root / "bad.xml").unlink()
    done = build(spark, str(root), str(out), default="Demo.Core")
    assert done["changed"] == 1 and done["deleted"] == 1
    build(spark, str(root), str(tmp_path / "full"), default="Demo.Core")
    assert tables(spark, out) == tables(spark, tmp_path / "full")
    edges = {(s, d, k) for s, d, k, _ in tables(spark, out)["edges_out"]}
    assert ("Engine.Thing", "Engine.IThing", "Implements") in edges and ("Engine.Pawn", "Engine.Thing", "Inherits") in edges


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.cs").write_text(PAWN)
    run = lambda: watch(spark, str(src), str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination(120)
    run()
    (src / "d.xml").write_text(DEFS)
    run()
    run()
    assert Index(spark, str(tmp_path / "i")).table("chunks").count() == 7


def test_service(spark, indexed):
    server = Server(Tools(Index(spark, str(indexed[1]))))
    say = lambda **m: server.answer({"jsonrpc": "2.0", **m})
    call = lambda name, **a: say(id=5, method="tools/call", params={"name": name, "arguments": a})
    assert say(id=1, method="initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert call("get_item", symbol="x")["error"]["code"] == -32002
    assert say(method="initialized") is None and say(method="tools/list") is None
    assert {t["name"] for t in say(id=2, method="tools/list")["result"]["tools"]} == {"rough_search", "get_uses", "get_used_by", "get_item"}
    assert say(id=3, method="what")["error"]["code"] == -32601 and call("what")["error"]["code"] == -32602
    for bad in ({"symbol": "x", "page": 0}, {"symbol": "x", "depth": 3}, {}, {"symbol": "x", "page": "1"}):
        assert call("get_uses", **bad)["error"]["code"] == -32602
    body = lambda r: json.loads(r["result"]["content"][0]["text"])
    uses = body(call("get_uses", symbol="Demo.Core.Door"))
    assert uses["symbol"] == "Demo.Core.Door" and uses["pagination"]["totalCount"] == len(uses["edges"]) > 0
    used = body(call("get_used_by", symbol="xml:ThingDef:Steel", kind="xml"))
    assert [e["id"] for e in used["edges"]] == ["xml:ThingDef:Door <- BaseDoor"] and used["edges"][0]["label"] == "referenced by def"
    assert body(call("get_item", symbol="xml:ThingDef:Door", max_lines=1))["id"] == "xml:ThingDef:Door <- BaseDoor"
    found = body(call("rough_search", query="door simple", kind="def", max_results=3))["results"]
    assert found and found[0]["lang"] == "xml"
    direct = hybrid.rough_search(Index(spark, str(indexed[1])).table("chunks"), "door simple", kind="def").collect()
    stored = Tools(Index(spark, str(indexed[1])), vectors.HashEmbedder(3))
    with pytest.raises(vectors.EmbeddingError):
        stored.rough_search({"query": "door"})
    stored.embed = None
    assert {r["id"] for r in stored.rough_search({"query": "door simple", "kind": "def"})["results"]} == {r.id for r in direct}
    out = io.StringIO()
    server.serve(io.StringIO('\n{"id":1,"method":"initialize"}\nnot json\n{"id":2,"method":"shutdown"}\n{"id":3,"method":"initialize"}\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [1, None, 2]


def test_command_line(spark, indexed, tmp_path):
    index = ["--index", str(indexed[1])]
    assert "Demo.Core.Door" in cli.run(["get-item", *index, "Demo.Core.Door", "--max-lines", "2"], spark)
    assert "inherited by" in cli.run(["get-used-by", *index, "Engine.Thing"], spark) or "page 1 of" in cli.run(["get-used-by", *index, "Demo.Core.Door"], spark)
    assert "Door" in cli.run(["rough-search", *index, "door"], spark)
    with pytest.raises(SystemExit):
        cli.run(["index"], spark)
    assert configured({"SYMGRAPH_INDEX": str(indexed[1])}) == str(indexed[1])
    with pytest.raises(FileNotFoundError):
        configured({}, str(tmp_path / "none.json"))


class Answers(BaseHTTPRequestHandler):
    """An embedding server and an API: the vector of a text is its length; the first API call is told to wait."""

    seen: list = []

    def do_GET(self):
        self.reply(200 if self.path == "/health" else 404, {})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body, self.headers.get("Authorization")))
        if self.path == "/embed":
            self.reply(200, {"vectors": [[float(len(i["text"])), 1.0] for i in body["items"]]})
        elif self.path == "/bad":
            self.reply(400, {})
        elif sum(p == "/api" for p, *_ in self.seen) == 1:
            self.reply(429, {}, {"Retry-After": "7"})
        else:
            self.reply(200, {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]})

    def reply(self, status, body, headers=()):
        self.send_response(status)
        for k, v in dict(headers).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_embedding_clients(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    http = vectors.HttpEmbedder(url)
    assert http.healthy() and http(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]] and Answers.seen[-1][1]["mode"] == "passage"
    assert not vectors.HttpEmbedder("http://127.0.0.1:9").healthy()
    api = vectors.ApiEmbedder(f"{url}/api", "k", "m", batch=2, sleep=waits.append)
    assert api(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and waits == [7.0, 0.1]
    assert Answers.seen[-1][1] == {"model": "m", "input": ["ccc"]} and Answers.seen[-1][2] == "Bearer k"
    with pytest.raises(vectors.EmbeddingError):
        vectors.ApiEmbedder(f"{url}/bad", "k", "m", sleep=waits.append)(["a"])
    c = spark.createDataFrame([("x", "words", None), ("y", "more words", None)], "id string, text string, preview string")
    got = {r.id: r.vector for r in vectors.embed(c, lambda: vectors.HttpEmbedder(url)).collect()}
    assert set(got) == {"x", "y"} and len(got["x"]) == 2
    assert isinstance(vectors.query_embedder("server", url), vectors.HttpEmbedder) and vectors.query_embedder("api", url, "m", 0, "k").key == "k"
    with pytest.raises(vectors.EmbeddingError):
        vectors.query_embedder("api", url, "m")
    server.shutdown()


def test_hash_embedders_of_passages_and_queries():
    passage, query = vectors.HashEmbedder(), vectors.HashEmbedder(query=True)
    assert passage.words("passage: Foo.BarBaz x") == ["foo.barbaz", "x"] and query.words("BarBaz(x)") == ["barbaz", "bar", "baz", "x"]
    assert query([""]) == [None] and abs(sum(x * x for x in query(["BarBaz"])[0]) - 1) < 1e-9


def test_ids_that_begin_alike_are_numbered_in_order(spark):
    ids = [f"xml:Thing:{i:04d}" for i in range(500)] + ["a", "z"]
    df = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids)] * 2, "id string, o int").repartition(9)
    got = sorted(map(tuple, graph.node_index(df).collect()))
    assert got == list(enumerate(sorted(ids)))
    by = sorted((k % 7, i) for k, i in enumerate(ids))
    assert sorted(map(tuple, graph.node_index(df, order=("o",)).collect())) == [(n, i) for n, (_, i) in enumerate(by)]
    assert graph.node_index(df.limit(0)).collect() == []


def test_jaro_counts_whole_transpositions_and_is_symmetric():
    from symgraph.functions.similarity import jaro, jaro_winkler_value

    assert jaro("xml:region:1", "xml:nation:1")[0] == pytest.approx((9 / 12 + 9 / 12 + 8 / 9) / 3)
    assert jaro("MARTHA", "MARHTA")[0] == pytest.approx(0.9444, abs=1e-4) and jaro("DIXON", "DICKSONX")[0] == jaro("DICKSONX", "DIXON")[0] == pytest.approx(0.7667, abs=1e-4)
    assert jaro_winkler_value("abc", "abc") == 1 and jaro_winkler_value("MARTHA", "MARHTA", True) == pytest.approx(0.9611, abs=1e-4)


def test_points_meet_the_spans_that_hold_them(spark):
    spans = spark.createDataFrame([("f", "a", 0, 100), ("f", "b", 10, 20), ("f", "empty", 5, 5), ("g", "c", 0, 9)], "path string, id string, span_start int, span_end int")
    points = spark.createDataFrame([("f", 0), ("f", 19), ("f", 20), ("f", 100), ("g", 9), ("h", 1), (None, 1)], "path string, offset int")
    for width in (1, 7, 4096):
        got = {(r.path, r.offset, r.id) for r in graph.containing(points, spans, width=width).collect()}
        assert got == {("f", 0, "a"), ("f", 19, "a"), ("f", 19, "b"), ("f", 20, "a")}


def test_namespaces_and_duplicates_by_language(spark):
    rows = spark.createDataFrame([("Engine.X", "a"), ("Other.Y", "a"), ("Mine.Z", "b"), ("Mine.Z", None), (None, "a")], "id string, lang string")
    assert {r.id for r in graph.in_namespaces(rows, ("Engine",)).collect()} == {"Engine.X"}
    assert {r.id for r in graph.in_namespaces(rows, ("Engine",), spark.createDataFrame([("Mine.Z",)], "id string")).collect()} == {"Engine.X", "Mine.Z"}
    assert [(r.id, r.occurrences, [(c.lang, c.n) for c in r.counts]) for r in graph.duplicate_ids(rows).collect()] == [("Mine.Z", 2, [(None, 1), ("b", 1)])]
