from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import embedding
from tessera.functions import scalars as S
from tessera.operators import chunks, graph, search, sync, typescript
from tessera.sources import files as sources
from tessera.streaming import refresh


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    one = lambda c, p: value(spark, c("p"), p=p)
    assert one(S.infer_feature, "src/features/Auth/hooks/useAuth.ts") == "Auth"
    assert one(S.infer_feature, "src/routes/api/users/route.ts") == "api"
    assert one(S.infer_feature, "src/utils/helpers.ts") is None
    assert one(S.pascal_case, "auth.service") == "AuthService"
    assert one(S.clean_version, "^16.0.1") == "16.0.1"
    assert [one(S.env_category, x) for x in ("OPENAI_API_KEY", "CLERK_SECRET_KEY", "DATABASE_URL", "S3_BUCKET", "ACCESS_CODE")] == ["LLM", "AUTH", "DATABASE", "S3", "OTHER"]
    assert value(spark, S.glob_match("p", "src/**/*.ts"), p="src/a.ts") is False
    assert value(spark, S.glob_match("p", "a/*.ts"), p="a/b/c.ts") is True
    cut, flag = S.truncated("p", 2000)
    assert value(spark, F.length(cut), p="x" * 3000) == 2003 and value(spark, flag, p="x" * 3000) is True


def test_routes(spark):
    route = lambda p: tuple(value(spark, S.route_of("p"), p=p))
    assert route("(group)/users/[id]") == ("/users/[id]", "page", None)
    assert route("@modal/login") == ("/login", "parallel", "@modal")
    assert route("feed/(.)photo") == ("/photo", "intercepted", None)
    assert route("") == ("/", "page", None)


def test_rerank_and_context(spark):
    rows = spark.createDataFrame([("a", 0.8, True, True), ("b", 0.8, False, False), ("c", 0.95, True, True)], "id string, score double, exported boolean, doc boolean")
    got = search.rerank(rows, "id", F.col("exported"), F.col("doc"), F.col("doc")).collect()
    assert [(r.id, round(r.adjusted_score, 2)) for r in got] == [("c", 1.0), ("a", 0.92), ("b", 0.8)]
    assert search.context_text(rows.limit(0)) == "No relevant code chunks found."


def test_asof_and_priority(spark):
    functions = spark.createDataFrame([("a.ts", "f", 10), ("a.ts", "f", 30), ("b.ts", "g", 1), ("a.ts", "h", 5), ("c.ts", "h", 1)], "file string, name string, line int")
    calls = spark.createDataFrame([("a.ts", "f", "g", 25), ("a.ts", "f", "h", 35), ("a.ts", "f", "g", 2), ("a.ts", None, "g", 40)], "file string, caller string, callee string, line int")
    who = {(r.line, r.caller_id) for r in graph.resolve_caller(calls, functions).collect()}
    assert who == {(25, "a.ts::f::10"), (35, "a.ts::f::30")}
    to = {(r.line, r.callee_id) for r in graph.resolve_callee(calls, functions).collect()}
    assert (35, "a.ts::h::5") in to and (25, "b.ts::g::1") in to


def test_imports_resolve_in_order(spark):
    imports = spark.createDataFrame([("src/app.ts", "./utils"), ("src/app.ts", "./auth.service"), ("src/app.ts", "@/lib"), ("src/app.ts", "../out")], "file string, source string")
    files = spark.createDataFrame([("src/utils.ts",), ("src/utils.tsx",), ("src/auth.service.ts",), ("src/lib/index.ts",)], "path string")
    assert {(r.source, r.target) for r in graph.resolve_imports(imports, files).collect()} == {("./utils", "src/utils.ts"), ("./auth.service", "src/auth.service.ts"), ("@/lib", "src/lib/index.ts")}


def test_cycles_once_a_rotation(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = graph.cycles(e).collect()
    assert sorted("".join(r.nodes) for r in got) == ["abca", "bcab", "cabc"]


def test_affected_one_level(spark):
    imports = spark.createDataFrame([("auth", "utils"), ("api", "auth")], "file string, target string")
    none = spark.createDataFrame([], "file string, callee string")
    functions = spark.createDataFrame([], "file string, name string")
    got = sync.affected(spark.createDataFrame([("utils",)], "path string"), imports, none, functions)
    assert {r.path for r in got.collect()} == {"utils", "auth"}


def test_mode():
    assert sync.mode(20, 100) == "incremental" and sync.mode(21, 100) == "full" and sync.mode(0, 0) == "full"


def test_change_lines(spark):
    lines = spark.createDataFrame([("R  a.ts -> b.ts",), (" D c.tsx",), ("?? notes.md",), (" M d.ts",)], "value string")
    assert {tuple(r) for r in sources.status_changes(lines).collect()} == {("a.ts", "deleted"), ("b.ts", "changed"), ("c.tsx", "deleted"), ("d.ts", "changed")}
    named = spark.createDataFrame([("R100\ta.ts\tb.ts",), ("D\tc.ts",), ("M\td.ts",)], "value string")
    assert {tuple(r) for r in sources.name_status_changes(named).collect()} == {("a.ts", "deleted"), ("b.ts", "changed"), ("c.ts", "deleted"), ("d.ts", "changed")}


CODE = """import React, { useState as us, useMemo } from 'react';
import type { User } from '@/types';
import * as path from 'path';
import './side.css';

/** Adds. */
export function add(a: number, b = 2): number {
  return helper(a).times(b);
}
const helper = async (x) => { const y = new Map(); return y.get(x); };
export const Button = ({ label, onClick }: Props) => {
  const [s, setS] = useState(0);
  return <button onClick={onClick}>{label}</button>;
};
export interface Props { label: string; onClick(): void }
type Id = string;
class Store extends React.Component { load() { this.fetch('x'); } }
export { helper as aid };
export * from './other';
export default Button;
"""


def test_typescript():
    got = typescript.extract("src/a.tsx", CODE)
    assert [(r["source"], r["import_kind"], r["default"], r["namespace"], r["type_only"], r["side_effect"]) for r in got["imports"]] == [
        ("react", "external", "React", None, False, False), ("@/types", "alias", None, None, True, False), ("path", "external", None, "path", False, False), ("./side.css", "relative", None, None, False, True)]
    assert got["imports"][0]["named"] == [{"name": "useState", "alias": "us"}, {"name": "useMemo", "alias": None}]
    f = {r["name"]: r for r in got["functions"]}
    assert (f["add"]["kind"], f["add"]["params"], f["add"]["line"], f["add"]["exported"]) == ("function", ["a", "b"], 7, True)
    assert (f["helper"]["kind"], f["helper"]["async"], f["helper"]["exported"]) == ("arrow", True, False)
    assert f["load"]["kind"] == "method"
    assert [(c["name"], c["kind"], c["props"]) for c in got["components"] if c["name"] == "Button"] == [("Button", "arrow", ["label", "onClick"])]
    assert any(c["kind"] == "class" and c["name"] == "Store" for c in got["components"])
    assert [(t["name"], t["kind"], t["members"], t["exported"]) for t in got["types"]] == [("Props", "interface", ["label", "onClick"], True), ("Id", "type", [], False)]
    calls = {(c["caller"], c["callee"], c["callee_object"], c["kind"]) for c in got["calls"]}
    assert ("add", "times", "helper(a)", "call") in calls and ("helper", "Map", None, "new") in calls and ("load", "fetch", "this", "call") in calls
    assert [(h["name"], h["caller"], h["args_count"]) for h in got["hooks"]] == [("useState", "Button", 1)]
    assert {(e["name"], e["kind"]) for e in got["exports"]} == {("add", "named"), ("Button", "named"), ("Props", "named"), ("aid", "named"), ("*", "re-export"), ("default", "default")}


def test_incremental_equals_full(spark, tmp_path):
    one = [("src/utils.ts", "export function util() { return 1; }\n"), ("src/app.ts", "import { util } from './utils';\nexport function main() { return util(); }\n")]
    two = [(one[0][0], "export function util() { return other(); }\nexport function other() { return 2; }\n"), one[1], ("src/new.ts", "import './app';\n")]
    frame = lambda rows: spark.createDataFrame(rows, schemas.FILES)
    a, b = sources.TableStore(spark, f"file://{tmp_path}/a"), sources.TableStore(spark, f"file://{tmp_path}/b")
    assert refresh.refresh(frame(one), a).mode == "full"
    refresh.refresh(frame(two), a)
    refresh.refresh(frame(two), b)
    assert refresh.refresh(frame(two), b).mode == "none"
    for name in ("imports", "functions", "calls", "nodes", "edges", "chunks", "snapshot"):
        x, y = a.read(name), b.read(name)
        assert sorted(map(str, x.select(*sorted(x.columns)).collect())) == sorted(map(str, y.select(*sorted(y.columns)).collect())), name
    assert ("CALLS", "src/app.ts::main::2", "src/utils.ts::util::1") in {(r.rel, r.src, r.dst) for r in a.read("edges").collect()}


def test_index_reuses_vectors(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "id string, text string")
    first = embedding.index(rows).cache()
    assert {r.id: len(r.embedding) for r in first.collect()} == {"a": 384, "b": 384}
    changed = spark.createDataFrame([("a", "one two"), ("b", "four")], "id string, text string")
    again = {r.id: list(r.embedding) for r in embedding.index(changed, first).collect()}
    before = {r.id: list(r.embedding) for r in first.collect()}
    assert again["a"] == before["a"] and again["b"] != before["b"]


def test_delete_keeps_what_others_use(spark):
    nodes = spark.createDataFrame([("File", "a"), ("File", "b"), ("Function", "a::f"), ("Module", "m"), ("Module", "n")], "label string, key string")
    e = spark.createDataFrame([("DEFINES", "File", "a", "Function", "a::f"), ("IMPORTS", "File", "a", "Module", "m"), ("IMPORTS", "File", "b", "Module", "n")], graph_schema())
    left, rel = graph.delete_files(nodes, e, spark.createDataFrame([("a",)], "path string"))
    assert {tuple(r) for r in left.collect()} == {("File", "b"), ("Module", "n")} and rel.count() == 1


def graph_schema():
    return ", ".join(f"{c} string" for c in graph.EDGE_COLUMNS)


def test_chunks(spark):
    text = "\n".join(["// one", "// two", "", "/** doc */", "export function f() {", "}"])
    files = spark.createDataFrame([("src/app/x/a.ts", text)], schemas.FILES)
    functions = spark.createDataFrame([("src/app/x/a.ts", "f", 5, True), ("src/app/x/a.ts", None, 6, False)], "file string, name string, line int, exported boolean")
    got = {r.id: r for r in chunks.of_relation(functions, files, "function").collect()}
    r = got["src/app/x/a.ts:function:f:5"]
    assert r.text == "// two\n\n/** doc */\nexport function f() {\n}" and r.feature == "x"
    assert "src/app/x/a.ts:function:anonymous:6" in got


def _functions(code, path="a.tsx"):
    return [(r["name"], r["exported"]) for r in typescript.extract(path, code)["functions"]]


def test_statements_without_semicolons():
    assert _functions("export default helper\nfunction late(){}") == [("late", False)]
    assert _functions("export const y = () => 1\nconst z = () => 2") == [("y", True), ("z", False)]
    assert _functions("export async function d(){}\nasync function c(){}\nfunction e(){} export function g(){}") == [("d", True), ("c", False), ("e", False), ("g", True)]


def test_export_within_four_nodes():
    assert _functions("export function f(){ function g(){} const h = () => 1; return () => 2 }") == [("f", True), ("g", True), ("h", False), (None, True)]
    assert _functions("export default memo(() => 1)\nexport const k = memo(() => 2);") == [(None, True), ("k", False)]
    assert _functions("export class A { m = () => 1; n(){} }\nexport const a = { b: () => 1 }") == [(None, True), (None, False), ("n", False)]


def test_jsx_text_is_no_code():
    code = "export function A(){ return <p>Don't {f(1)}</p>; }\nfunction B(){ return g(2) }"
    assert _functions(code) == [("A", True), ("B", False)]
    assert [(r["caller"], r["callee"]) for r in typescript.extract("a.tsx", code)["calls"]] == [("A", "f"), ("B", "g")]
    code = "const X = () => (<div a={() => k(1)} b='x>y'>it's <b/> text (not call) {list.map(i => <li key={i}>{i} can't</li>)}</div>)\nexport const Y = () => <><X/>isn't</>\nexport function Z(){ use() }"
    assert [(r["name"], r["exported"]) for r in typescript.extract("a.tsx", code)["components"]] == [("X", False), ("Y", True)]
    assert [r["callee"] for r in typescript.extract("a.tsx", code)["calls"]] == ["k", "map", "use"]
    assert _functions("const a = <T,>(x: T) => x;\nconst b = x < y && z > 3;\nexport function e(){}") == [("a", False), ("e", True)]


def test_extraction_time_grows_with_the_file():
    import time

    took = []
    for n in (4000, 16000):
        code = "\n".join(f"export const f{i} = (a, b) => g{i}(a.b.c({i}))" for i in range(n))
        began = time.process_time()
        assert len(typescript.extract("x.ts", code)["calls"]) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_odd_files_are_reported(spark, monkeypatch):
    files = spark.createDataFrame([("a.ts", "f()"), ("b.ts", None), ("c.txt", "f()")], "path string, content string")
    out = typescript.extract_files(files)
    assert [tuple(r) for r in typescript.rejects(out).collect()] == [("b.ts", "not valid UTF-8")]
    assert [r.callee for r in typescript.relation(out, "calls").collect()] == ["f"]


def test_extraction_is_spread(spark):
    files = spark.createDataFrame([(f"{i}.ts", f"f{i}()") for i in range(200)], "path string, content string").coalesce(1)
    out = typescript.extract_files(files)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert typescript.relation(out, "calls").count() == 200


def test_chunks_split_a_file_once(spark):
    files = spark.createDataFrame([("a.ts", "// x\n\n\nf()\ng()\n")], "path string, content string")
    rows = spark.createDataFrame([("a.ts", "f", 4, True)], "file string, name string, line int, exported boolean")
    out = chunks.of_relation(rows, files, "function")
    assert [r.text for r in out.collect()] == ["// x\n\n\nf()\ng()"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4  # as lines_of has them
