"""Collections, providers, settings, command line, refresh reports and documented graph questions."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli, schemas, settings
from tessera.functions import embedding
from tessera.operators import graph, reports, sync, typescript
from tessera.sources import files as sources
from tessera.sources.collections import Collection
from tessera.streaming import refresh

SOURCES = {
    "src/app/api/users/route.ts": "import { list } from '@/lib/db';\nexport async function GET(r) { return list(r) }\nfunction own() {}\n",
    "src/lib/db.ts": "import pg from 'pg';\nimport './log';\nexport function list(a, b) { return pg.query(a) }\n",
    "src/lib/log.ts": "import './db';\nexport const log = () => 1\n",
    "src/alone.ts": "const x = 1\n",
    "src/Card.tsx": "import { useState } from 'react';\nexport const Card = ({ a }) => { const [s] = useState(0); useState(1); return <p>Don't {log(s)}</p> }\n",
    "src/store/user/index.ts": "export const useUser = create(() => 1)\nexport function login(name) {}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(SOURCES.items()), schemas.FILES)
    out = typescript.extract_files(files).cache()
    rel = {k: typescript.relation(out, k) for k in schemas.AST}
    routes = spark.createDataFrame([("/api/users", "api", "src/app/api/users/route.ts", ["GET"], None), ("/gone", "page", "src/none.tsx", None, None)], "route string, type string, file string, methods array<string>, slot string")
    stores = spark.createDataFrame([("user", "src/store/user", ["auth"], ["persist"])], "store string, path string, slices array<string>, middleware array<string>")
    nodes, edges = graph.build(*(rel[x] for x in ("imports", "functions", "components", "types", "hooks", "calls")), routes=routes, stores=stores, files=files)
    return graph.Graph(nodes.cache(), edges.cache())


def test_questions(found):
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(found.callees("GET")) == [("GET", "list", "src/lib/db.ts")]
    assert rows(found.components_using("useState")) == []  # a component that is a function, too, uses hooks as a function
    assert rows(found.import_chains("src/app/api/users/route.ts")) == [(["src/app/api/users/route.ts", "src/lib/db.ts"], 1), (["src/app/api/users/route.ts", "src/lib/db.ts", "src/lib/log.ts"], 2), (["src/app/api/users/route.ts", "src/lib/db.ts", "src/lib/log.ts", "src/lib/db.ts"], 3)]
    assert [r[0] for r in rows(found.circular_imports())] == [["src/lib/db.ts", "src/lib/log.ts", "src/lib/db.ts"], ["src/lib/log.ts", "src/lib/db.ts", "src/lib/log.ts"]]
    assert sorted(r[0] for r in rows(found.orphan_files())) == ["src/alone.ts", "src/store/user", "src/store/user/index.ts"]
    assert rows(found.routes_under("src/app/api/")) == [("src/app/api/users/route.ts", "/api/users", "GET")]
    assert rows(found.route_handlers()) == [("/api/users", "GET", "function", "src/app/api/users/route.ts")]
    assert [r[0] for r in rows(found.functions_of_store("user"))] == ["useUser", "login"]
    assert ("user", "login", "name", True, "src/store/user/index.ts") in rows(found.store_functions())
    assert rows(found.modules()) == [("pg", 1), ("react", 1)]
    assert rows(found.hook_usage()) == [("useState", "Function", 1)]
    assert rows(found.busy_components(0)) == [("Card", "src/Card.tsx", 1)]
    assert rows(found.most_called(0))[0][3] >= 1
    assert {(r[0], r[1]) for r in rows(found.totals())} >= {("node", "File"), ("node", "Route"), ("edge", "IMPORTS")}
    assert graph.duplicate_keys(found.nodes).count() == 0
    assert found.listing(2).count() == 2 and found.cleared().totals().count() == 0


def test_hooks_of_components(spark):
    nodes = spark.createDataFrame([("Component", "f::B", "B", "f"), ("Component", "f::A", "A", "f"), ("Hook", "useX", "useX", None), ("Hook", "useY", "useY", None)], "label string, key string, name string, file string")
    e = spark.createDataFrame([("USES_HOOK", "Component", c, "Hook", h) for c, h in (("f::A", "useX"), ("f::A", "useY"), ("f::B", "useX"))], ", ".join(f"{c} string" for c in graph.EDGE_COLUMNS))
    g = graph.Graph(nodes, e)
    assert [tuple(r) for r in g.components_using("useX").collect()] == [("A", "f"), ("B", "f")]
    assert [tuple(r) for r in g.hooks_of_components().collect()] == [("f::A", "A", ["useX", "useY"], 2), ("f::B", "B", ["useX"], 1)]
    assert [tuple(r) for r in g.hook_usage().collect()] == [("useX", "Component", 2), ("useY", "Component", 1)]


def test_edges_need_their_files(found):
    assert found.edges.where("rel = 'HAS_ROUTE'").count() == 1  # the route of a file that is not there hangs on nothing
    assert found.nodes.where("label = 'Route'").count() == 2
    one = found.nodes.where("key = '/api/users'").first()
    assert one.properties == {"type": "api", "methods": "GET"}
    f = found.nodes.where("name = 'GET'").first()
    assert f.properties == {"is_async": "true", "params": "r"}
    bare = graph.with_endpoints(found.nodes.where("label != 'Module'"), found.edges)
    assert bare.where("label = 'Module'").count() == 2
    assert graph.matched(found.edges, found.nodes.where("label = 'File'")).where("rel = 'CALLS'").count() == 0


def test_sql_over_the_graph(found):
    assert found.rows("SELECT key FROM {nodes} WHERE label = :label ORDER BY key", label="Module") == [{"key": "pg"}, {"key": "react"}]


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([("Function", "k", "b.ts", 1, "late"), ("Function", "k", "a.ts", 9, "early")], "label string, key string, file string, line int, name string")
    rows = rows.select("label", "key", "file", "name", F.lit(None).cast("string").alias("kind"), "line", F.lit(None).cast("boolean").alias("exported"), F.lit(None).cast(graph.PROPERTIES).alias("properties"))
    assert graph.last_wins([rows]).first().name == "late"
    assert graph.last_wins([rows, rows.where("name = 'early'")]).first().name == "early"


def test_deletion_is_counted(found, spark):
    left, counts = found.without(spark.createDataFrame([("src/lib/db.ts",)], "path string"))
    assert counts["modules_deleted"] == 1 and counts["nodes_deleted"] == 3 and counts["edges_deleted"] > 0
    assert left.nodes.where("key = 'pg'").count() == 0


def test_cycles_of_all_lengths(spark):
    import itertools

    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 7, (18, 2))}
    want = set()
    for n in range(1, 6):
        for nodes in itertools.product(range(7), repeat=n):
            path = [*nodes, nodes[0]]
            steps = list(zip(path, path[1:], strict=False))
            if set(steps) <= pairs and len(set(steps)) == n:
                want.add(tuple(path))
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = [tuple(r.nodes) for r in graph.cycles(e, 1, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_numbered(spark):
    got = {r.x: r.batch for r in graph.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5), 32, "x").collect()}
    assert got == {i: i // 32 for i in range(1000)}
    assert graph.numbered(spark.range(0).select(F.col("id").alias("x")), 32, "x").count() == 0


def test_merge_by_prefix(spark):
    old = spark.createDataFrame([("src/store/a", 1), ("src/store/ab", 1), ("src/x.ts", 1)], "path string, v int")
    fresh = old.withColumn("v", F.lit(2))
    changed = spark.createDataFrame([("src/store/a/deep/x.ts",), ("src/x.ts",)], "path string")
    assert {tuple(r) for r in sync.merge(old, fresh, changed, "path", by_prefix=True).collect()} == {("src/store/a", 2), ("src/store/ab", 1), ("src/x.ts", 2)}
    assert {tuple(r) for r in sync.merge(old, fresh, changed, "path").collect()} == {("src/store/a", 1), ("src/store/ab", 1), ("src/x.ts", 2)}


def test_json_artifacts(spark, tmp_path):
    for name, text in (("list", '[{"a": 1}, {"a": 2}]'), ("one", '{"a": 3}'), ("bad", '[{"a": 1}'), ("text", '"x"')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda n, **k: [r.a for r in sources.read_json(spark, f"file://{tmp_path}/{n}.json", "a int", **k).collect()]
    assert read("list") == [1, 2] and read("one") == [] and read("one", wrap=True) == [3]
    assert read("bad") == read("text") == read("missing") == []


def test_store_defaults_and_age(spark, tmp_path):
    store = sources.TableStore(spark, f"file://{tmp_path}/s")
    default = spark.createDataFrame([], "a int")
    assert store.read("x") is None and store.read("x", default) is default
    store.write(spark.range(1), "x")
    assert store.read("x", default) is default and store.read("x").count() == 1
    with pytest.raises(ValueError, match="missing"):
        store.validate(["x", "y"])
    store.validate(["x"])
    with pytest.raises(ValueError, match="old"):
        store.validate(["x"], 10, now=store.modified("x") + 11)
    store.validate(["x"], 0, now=store.modified("x") + 1e9)


def test_refresh_modes_and_counts(spark, tmp_path):
    frame = lambda d: spark.createDataFrame(list(d.items()), schemas.FILES)
    store = sources.TableStore(spark, f"file://{tmp_path}/r")
    first = refresh.refresh(frame(SOURCES), store, provider="hashing")
    assert first.mode == "full" and first.created["nodes"] == first.sizes["nodes"] and first.removed["vectors"] == 0
    assert refresh.refresh(frame(SOURCES), store).mode == "none"
    forced = refresh.refresh(frame(SOURCES), store, force=True)
    assert forced.mode == "full" and forced.created["nodes"] == forced.removed["nodes"] == 0 and forced.changed == 0
    vectors = {r.id: list(r.embedding) for r in store.read("vectors").collect()}
    new = SOURCES | {"src/lib/log.ts": "export const log = () => 2\nexport function more() {}\n"}
    done = refresh.refresh(frame(new), store, provider="hashing")
    assert (done.mode, done.changed, done.deleted) == ("incremental", 1, 0)
    assert done.affected == 2 + 1 - 1 or done.affected >= 2  # the file and what imports it
    after = {r.id: list(r.embedding) for r in store.read("vectors").collect()}
    assert set(after) - set(vectors) == {"src/lib/log.ts:function:log:1", "src/lib/log.ts:function:more:2"}
    assert "src/lib/log.ts:function:log:2" not in after and all(after[k] == vectors[k] for k in set(after) & set(vectors))
    del new["src/alone.ts"]
    assert refresh.refresh(frame(new), store, threshold=0.5).deleted == 1


class Fake(BaseHTTPRequestHandler):
    calls: list = []
    fail: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Fake.calls.append((len(body["input"]), self.headers.get("Authorization")))
        code = Fake.fail.pop(0) if Fake.fail else 500 if "poison" in body["input"] else 200
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Fake.calls, Fake.fail = [], []
    s = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/embed"
    s.shutdown()


def test_http_provider(server):
    p = embedding.HttpProvider(server, "m", "secret", batch=2, least_wait=0.01)
    Fake.fail = [503, 429]
    assert p(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]]
    assert [n for n, _ in Fake.calls] == [2, 2, 2, 1] and Fake.calls[0][1] == "Bearer secret" and "secret" not in repr(p)
    Fake.calls, Fake.fail = [], [401]
    with pytest.raises(embedding.AuthError):
        p(["a"])
    assert len(Fake.calls) == 1
    Fake.calls, Fake.fail = [], [500] * 3
    with pytest.raises(Exception, match="500"):
        p(["a"])
    assert len(Fake.calls) == 3
    with pytest.raises(ValueError):
        embedding.HttpProvider(server, "")
    with pytest.raises(Exception, match="refused|Errno"):
        embedding.HttpProvider("http://127.0.0.1:1/", "m", least_wait=0.01)(["a"])


def test_index_codebase(spark, tmp_path, server):
    store = sources.TableStore(spark, f"file://{tmp_path}/i")
    rows = [(f"c{i}", "poison" if i == 3 else "x" * (i + 1), "function" if i % 2 else "type") for i in range(9)]
    made = spark.createDataFrame(rows, "id string, text string, chunk_type string")
    p = embedding.HttpProvider(server, "m", attempts=1)
    c = Collection(store)
    done = embedding.index_codebase(made, c, p, batch=4)
    assert (done.total_chunks, done.embedded, done.stored, done.skipped, done.failed) == (9, 8, 8, 0, 1) and done.types == {"function": 4, "type": 5}
    assert [e["chunk_id"] for e in done.errors] == ["c3"] and c.info()["dimension"] == 2 and c.info()["points"] == 8
    again = embedding.index_codebase(made, c, p, batch=4)
    assert (again.skipped, again.failed, again.stored) == (8, 1, 0)
    assert embedding.index_codebase(made, c, p, force=True).stored == 8
    assert "indexing failed" in embedding.index_codebase(made, c, "no such provider").errors[0]["error"]
    assert embedding.index_codebase(made.limit(0), c, p).total_chunks == 0


def test_collection(spark, tmp_path):
    c = Collection(sources.TableStore(spark, f"file://{tmp_path}/c"))
    points = spark.createDataFrame([("a", "f.ts", [1.0, 0.0]), ("b", "g.ts", [0.0, 1.0])], "id string, file string, embedding array<float>")
    with pytest.raises(ValueError):
        c.upsert(points)
    with pytest.raises(ValueError):
        c.create(None)
    c.create(2, "no such metric")
    assert c.info() == {"name": "code", "points": 0, "dimension": 2, "metric": "cosine"}
    assert c.upsert(points) == 2 and c.upsert(points.where("id = 'a'").withColumn("file", F.lit("h.ts"))) == 1 and c.upsert(points.limit(0)) == 0
    with pytest.raises(ValueError, match="dimension"):
        c.upsert(points.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert [(r.id, r.file) for r in c.search([1.0, 0.1], 1).collect()] == [("a", "h.ts")]
    assert c.delete(F.col("file") == "none") == 0 and c.delete(F.col("id") == "a") == 1
    assert c.delete_files(spark.createDataFrame([("g.ts",)], "path string")) == 1 and c.info()["points"] == 0
    c.drop()
    assert not c.exists() and c.info() is None


def test_settings():
    s = settings.load({"tessera_embedding_batch_size": "7", "TESSERA_SYNC_UPDATE_EMBEDDINGS": "no", "TESSERA_EMBEDDING_KEY": "k", "OTHER": "x", "TESSERA_VECTOR_DIMENSION": "12"})
    assert (s.embedding_batch_size, s.sync_update_embeddings, s.embedding_key, s.vector_dimension) == (7, False, "k", 12) and "'k'" not in repr(s)
    with pytest.raises(ValueError):
        settings.load({"TESSERA_SYNC_FALLBACK_THRESHOLD": "2"})
    with pytest.raises(ValueError):
        settings.provider(settings.load({"TESSERA_EMBEDDING_PROVIDER": "none"}))
    assert isinstance(settings.provider(settings.load({"TESSERA_EMBEDDING_PROVIDER": "http", "TESSERA_EMBEDDING_MODEL": "m"})), embedding.HttpProvider)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    for path, text in (SOURCES | {"package.json": '{"dependencies": {"next": "15.0.0"}}'}).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    def run(*argv):
        code = cli.main([*argv], spark, {})
        return code, capsys.readouterr().out

    at = ("--path", str(tmp_path))
    assert run("version")[1].startswith("tessera ") and "store" in run("status")[1]
    assert run("summarize-repo", *at)[0] == 1 and run("search-code", "x", *at)[0] == 1 and run("build-graph", *at)[0] == 2
    code, out = run("scan-repo", *at, "--verbose")
    assert code == 0 and "Next.js" in out and "/api/users" in out
    assert "Next.js" in run("summarize-repo", *at)[1]
    assert "functions    5" in run("index-code", *at)[1] or "functions" in run("index-code", *at)[1]
    assert "IMPORTS" in run("build-graph", *at)[1]
    assert "src/lib/log.ts" in run("query-graph", *at, "SELECT key FROM {nodes} WHERE label = 'File'")[1]
    assert "stored" in run("index-embeddings", *at)[1]
    assert "src/lib/db.ts" in run("search-code", "list query", *at, "--type", "function")[1]
    assert "# " in run("search-code", "list", *at, "--format", "context")[1]
    assert "dimension    384" in run("embedding-status", *at)[1]
    assert "mode full" in run("sync-repo", *at)[1] and "no changes" in run("sync-repo", *at)[1] and "mode full" in run("sync-repo", *at, "--full")[1]
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert run("clear-embeddings", *at)[0] == 1
    assert run("clear-embeddings", *at, "-f")[0] == 0 and run("embedding-status", *at)[0] == 1
    assert json.loads(run("run-task", "echo hi")[1])["stdout"] == "hi\n"
    assert run("scan-repo", "--path", f"{tmp_path}/none")[0] == 2


def test_reports(spark):
    rows = spark.createDataFrame([("b", ["x", "y", "z"]), ("a", [])], "name string, files array<string>")
    assert reports.text(reports.ordered("scripts", rows)).splitlines()[2].startswith("a") and "... 2 rows" in reports.text(rows, 1)
    assert [r[0] for r in rows.select(reports.first_names(F.col("files"), 2)).collect()] == ["x, y (+1)", ""]
    assert reports.report({"scripts": rows, "libs": rows.limit(0)}).startswith("scripts\n")
