"""A repository made from the test tables, and queries that run the engine's operators on it.

Each customer is a module, each supplier a component file; nations and regions give pages, routes, stores, services and the
like. The SQL of a query tells the rows straight from the tables, so it shares nothing with the operators it checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import embedding
from ..functions import scalars as S
from ..operators import app_detectors as A
from ..operators import chunks, graph, scanner, search, sync, typescript
from ..operators import detectors as D
from ..sources import files as sources
from ..sources.scratch import Scratch
from ..sources.tables import table
from .catalogue import register

MODULE = """import {{ helper as h }} from './m{n}';
import ext, {{ a }} from 'pkg{m}';
import type {{ T }} from '@/types/t';
import './side.css'
export function f{k}(a, b) {{
  return h(a).times(ext.run(b))
}}
export const g{k} = async (x) => {{ const y = new Map(); return f{k}(x, y) }}
function own{k}() {{ g{k}(1); f{n}(2, 3) }}
export interface T{k} {{ id: string; name: string }}
type I{k} = string
export {{ own{k} as out{k} }}
"""
VIEW = """import {{ useState, useMemo }} from 'react';
import {{ f{n} }} from '../lib/m{n}';
interface S{k}Props {{
  id: string;
  label: string;
}}
export function S{k}({{ id, label }}: S{k}Props) {{
  const [v] = useState(0)
  const w = useMemo(() => f{n}(v, 1), [v])
  return <p title="it's">Don't {{w}} {{label}}</p>
}}
"""


def _text(template: str, **columns: Column) -> Column:
    return F.format_string(template.replace("%", "%%").format(**{name: f"%{i + 1}$s" for i, name in enumerate(columns)}), *columns.values())


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def modules(spark: SparkSession, d: str) -> DataFrame:
    k = _s("c_custkey")
    text = _text(MODULE, k=k, n=_s(F.col("c_nationkey") + 1), m=_s("c_nationkey"))
    return table(spark, d, "customer").select(F.concat(F.lit("src/lib/m"), k, F.lit(".ts")).alias("path"), text.alias("content"))


def views(spark: SparkSession, d: str) -> DataFrame:
    k = _s("s_suppkey")
    text = _text(VIEW, k=k, n=_s(F.col("s_nationkey") + 1))
    return table(spark, d, "supplier").select(F.concat(F.lit("src/components/S"), k, F.lit(".tsx")).alias("path"), text.alias("content"))


def app(spark: SparkSession, d: str) -> DataFrame:
    """All but modules and components."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    n, r = _s("n_nationkey"), _s("r_regionkey")

    def each(key: Column, path: str, text: str = "") -> Column:
        return F.struct(_text(path, k=key).alias("path"), _text(text, k=key).alias("content"))

    def listed(key: Column, path: str, head: str, line: str, tail: str = "", glue: str = "\n") -> Column:
        lines = F.array_join(F.sort_array(F.collect_list(_text(line, k=key))), glue)
        return F.struct(F.lit(path).alias("path"), F.concat(F.lit(head), lines, F.lit(tail)).alias("content"))

    category = F.when(F.col("r_regionkey") % 3 == 0, "OPENAI_").when(F.col("r_regionkey") % 3 == 1, "CLERK_").otherwise("ZZ_")
    env = F.concat(category, F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("=1"))
    of_nation = [
        each(n, "src/app/(main)/n{k}/page.tsx", "export default function Page{k}() {{}}"),
        each(n, "src/app/api/n{k}/route.ts", "export const POST = (r) => r\nexport async function GET(r) {{ return r }}\n"),
        each(n, "src/hooks/useN{k}.ts", "export function useN{k}(a: string, b = 2) {{}}"),
    ]
    of_region = [
        each(r, "src/store/r{k}/index.ts", "export const useR{k} = create(persist(() => 1))\nexport function act{k}(a) {{}}"),
        each(r, "src/store/r{k}/slices/auth.ts"),
        each(r, "src/services/region{k}.service.ts", "export const key{k} = 1\nexport function run{k}() {{}}"),
        each(r, "scripts/s{k}.ts"),
        each(r, "scripts/d{k}/a.ts"),
        each(r, "src/libs/l{k}/x.ts"),
        each(r, "src/libs/agent-runtime/p{k}/index.ts", "new ReadableStream(); image_url"),
        each(r, "src/libs/next-auth/sso-providers/sso{k}.ts"),
        each(r, "src/server/routers/lambda/r{k}.ts", "createTRPCRouter({{ list{k}: p.query(f), add{k}: p.input(x).mutation(g) }})"),
        each(r, "src/server/modules/M{k}/index.ts", "export class Mod{k} {{}}\nexport async function run{k}() {{}}"),
        each(r, "locales/en-US/r{k}.json"),
        each(r, "src/locales/default/ns{k}.ts"),
    ]
    of_regions = [
        F.struct(F.lit(".env.example").alias("path"), F.array_join(F.sort_array(F.collect_list(env)), "\n").alias("content")),
        listed(r, "package.json", '{"dependencies": {"next": "^15.1.0", "@radix-ui/x": "1", "prisma": "6", ', '"pkg-r{k}": "^1.{k}.0"', '}, "devDependencies": {"zustand": "5"}}', ", "),
        listed(r, "src/middleware.ts", "export const config = { matcher: [", "'/r{k}'", "] }", ", "),
        listed(r, "src/auth.ts", "NextAuth({ session: { strategy: 'jwt' } })\n", "// {k}"),
        listed(r, ".i18nrc.js", "module.exports = { sourceLocale: 'en', outputLocales: [", "'l{k}'", "] }", ", "),
        listed(r, "pnpm-lock.yaml", "", "{k}"),
        listed(r, "tsconfig.json", "", "{k}"),
    ]
    of_nations = [listed(n, "prisma/schema.prisma", "", "model N{k} {{\n  id Int\n  name{k} String\n}}\n")]
    parts = [
        nation.select(F.explode(F.array(*of_nation)).alias("f")),
        region.select(F.explode(F.array(*of_region)).alias("f")),
        region.agg(F.array(*of_regions).alias("f")).select(F.explode("f").alias("f")),
        nation.agg(F.array(*of_nations).alias("f")).select(F.explode("f").alias("f")),
    ]  # one scan each, as a graph's plan holds this many times
    return reduce(DataFrame.unionByName, parts).select("f.*")


def _extracted(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations, from a stored table: every file is read once, and a query reads the columns it needs."""
    out = Scratch(spark, "extracted").save(typescript.extract_files(modules(spark, d).unionByName(views(spark, d))), "files")
    return {name: typescript.relation(out, name) for name in schemas.AST}


_C = "SELECT 'src/lib/m' || c_custkey || '.ts' AS file, c_custkey AS k, c_nationkey + 1 AS n, c_nationkey AS m FROM customer"
_V = "SELECT 'src/components/S' || s_suppkey || '.tsx' AS file, s_suppkey AS k, s_nationkey + 1 AS n FROM supplier"

# extraction -----------------------------------------------------------------------


@register(
    f"""WITH c AS ({_C}), v AS ({_V})
SELECT file, './m' || n AS source, 'relative' AS kind, 'helper>h' AS names, false AS type_only, false AS side_effect, 1 AS line FROM c
UNION ALL SELECT file, 'pkg' || m, 'external', 'ext;a>', false, false, 2 FROM c UNION ALL SELECT file, '@/types/t', 'alias', 'T>', true, false, 3 FROM c
UNION ALL SELECT file, './side.css', 'relative', '', false, true, 4 FROM c UNION ALL SELECT file, 'react', 'external', 'useState>,useMemo>', false, false, 1 FROM v
UNION ALL SELECT file, '../lib/m' || n, 'relative', 'f' || n || '>', false, false, 2 FROM v"""
)
def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    named = F.array_join(F.transform("named", lambda x: F.concat(x["name"], F.lit(">"), F.coalesce(x["alias"], F.lit("")))), ",")
    return _extracted(spark, d)["imports"].select("file", "source", F.col("import_kind").alias("kind"), F.concat(F.coalesce(F.concat("default", F.lit(";")), F.lit("")), named).alias("names"), "type_only", "side_effect", "line")


@register(
    f"""WITH c AS ({_C}), v AS ({_V})
SELECT file, 'f' || k AS name, 'function' AS kind, false AS is_async, 'a,b' AS params, 5 AS line, true AS exported FROM c UNION ALL SELECT file, 'g' || k, 'arrow', true, 'x', 8, true FROM c
UNION ALL SELECT file, 'own' || k, 'function', false, '', 9, false FROM c UNION ALL SELECT file, 'S' || k, 'function', false, '', 7, true FROM v UNION ALL SELECT file, 'w', 'arrow', false, '', 9, false FROM v"""
)
def extract_functions(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["functions"].select("file", "name", "kind", F.col("async").alias("is_async"), F.array_join("params", ",").alias("params"), "line", "exported")


_CALLS = f"""WITH c AS ({_C}), v AS ({_V})
SELECT file, 'f' || k AS caller, 'times' AS callee, 'h(a)' AS callee_object, 'call' AS kind, 6 AS line FROM c UNION ALL SELECT file, 'f' || k, 'run', 'ext', 'call', 6 FROM c
UNION ALL SELECT file, 'g' || k, 'Map', NULL, 'new', 8 FROM c UNION ALL SELECT file, 'g' || k, 'f' || k, NULL, 'call', 8 FROM c UNION ALL SELECT file, 'own' || k, 'g' || k, NULL, 'call', 9 FROM c
UNION ALL SELECT file, 'own' || k, 'f' || n, NULL, 'call', 9 FROM c UNION ALL SELECT file, 'S' || k, 'useState', NULL, 'call', 8 FROM v UNION ALL SELECT file, 'S' || k, 'useMemo', NULL, 'call', 9 FROM v
UNION ALL SELECT file, 'w', 'f' || n, NULL, 'call', 9 FROM v"""


@register(_CALLS)
def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["calls"]


@register(_CALLS)
def call_graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return graph.flat_calls(graph.nested_calls(_extracted(spark, d)["calls"])).select("file", "caller", "callee", "callee_object", "kind", "line")


@register(
    f"""WITH c AS ({_C}), v AS ({_V}) SELECT file, 'f' || k AS name, 'f' || k AS local_name, 'named' AS kind, false AS type_only, 5 AS line FROM c UNION ALL SELECT file, 'g' || k, 'g' || k, 'named', false, 8 FROM c
UNION ALL SELECT file, 'T' || k, 'T' || k, 'named', true, 10 FROM c UNION ALL SELECT file, 'out' || k, 'own' || k, 'named', false, 12 FROM c UNION ALL SELECT file, 'S' || k, 'S' || k, 'named', false, 7 FROM v"""
)
def extract_exports(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["exports"].select("file", "name", "local_name", "kind", "type_only", "line")


@register(
    f"""WITH c AS ({_C}), v AS ({_V}) SELECT file, 'T' || k AS name, 'interface' AS kind, true AS exported, 'id,name' AS members, 10 AS line FROM c UNION ALL SELECT file, 'I' || k, 'type', false, '', 11 FROM c
UNION ALL SELECT file, 'S' || k || 'Props', 'interface', false, 'id,label', 3 FROM v"""
)
def extract_types(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["types"].select("file", "name", "kind", "exported", F.array_join("members", ",").alias("members"), "line")


@register(f"WITH v AS ({_V}) SELECT file, 'useState' AS name, 'S' || k AS caller, 1 AS args_count, 8 AS line FROM v UNION ALL SELECT file, 'useMemo', 'S' || k, 2, 9 FROM v")
def extract_hooks(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["hooks"]


@register(f"SELECT file, 'S' || k AS name, 'function' AS kind, 'id,label' AS props, true AS exported, 7 AS line FROM ({_V})")
def extract_components(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)["components"].select("file", "name", "kind", F.array_join("props", ",").alias("props"), "exported", "line")


@register("SELECT 'src/bad' || r_regionkey || '.ts' AS path, 'not valid UTF-8' AS error FROM region")
def extract_rejects(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "region").select(F.concat(F.lit("src/bad"), _s("r_regionkey"), F.lit(".ts")).alias("path"), F.lit(None).cast("string").alias("content"))
    return typescript.rejects(typescript.extract_files(bad.unionByName(views(spark, d))))


# graph ------------------------------------------------------------------------------


def _built(spark: SparkSession, d: str) -> graph.Graph:
    """The graph over stored relations, for what reads its nodes and edges once. Only asked labels and relations are made."""
    rel, other = _extracted(spark, d), Scratch(spark, "app").save(app(spark, d), "files")
    paths = modules(spark, d).unionByName(views(spark, d)).unionByName(other).select("path")
    return graph.Graph(*graph.build(*(rel[x] for x in ("imports", "functions", "components", "types", "hooks", "calls")), routes=D.routes(other), services=D.services(other), stores=A.stores(other), files=paths))


LABELS = ("File", "Function", "Component", "Type", "Hook", "Module", "Route", "Service", "Store")
RELS = ("IMPORTS", "DEFINES", "CALLS", "USES_HOOK", "HAS_ROUTE", "BELONGS_TO", "HAS_STORE")


def _graph(spark: SparkSession, d: str, labels: tuple[str, ...] | None = None, rels: tuple[str, ...] | None = None) -> graph.Graph:
    """The graph as stored tables, so that the plan of a question holds none of what builds it; of a question that
    asks for certain labels and relations only, all nodes and edges of these."""
    g, kept = _built(spark, d), Scratch(spark, "graph")

    def stored(rows: DataFrame, kind: str, asked: tuple[str, ...] | None, known: tuple[str, ...], name: str) -> DataFrame:
        """One label or relation at a time, as the driver's memory grows with a plan; a last part has those not known here."""
        parts = [F.col(kind) == x for x in (known if asked is None else asked)] + ([~F.col(kind).isin(*known)] if asked is None else [])
        return spark.read.schema(rows.schema).parquet(*[kept.save(rows.where(x), name)._tessera_path for x in parts])

    nodes = g.nodes if labels == () else stored(g.nodes, "label", labels, LABELS, "nodes")
    return graph.Graph(nodes, stored(g.edges, "rel", rels, RELS, "edges"))


_FILES = f"""SELECT file FROM ({_C}) UNION ALL SELECT file FROM ({_V}) UNION ALL SELECT unnest(['src/app/(main)/n' || n_nationkey || '/page.tsx', 'src/app/api/n' || n_nationkey || '/route.ts', 'src/hooks/useN' || n_nationkey || '.ts']) FROM nation
UNION ALL SELECT unnest(['src/store/r' || k || '/index.ts', 'src/store/r' || k || '/slices/auth.ts', 'src/services/region' || k || '.service.ts', 'scripts/s' || k || '.ts', 'scripts/d' || k || '/a.ts', 'src/libs/l' || k || '/x.ts', 'src/libs/agent-runtime/p' || k || '/index.ts',
 'src/libs/next-auth/sso-providers/sso' || k || '.ts', 'src/server/routers/lambda/r' || k || '.ts', 'src/server/modules/M' || k || '/index.ts', 'locales/en-US/r' || k || '.json', 'src/locales/default/ns' || k || '.ts']) FROM (SELECT r_regionkey AS k FROM region)
UNION ALL SELECT unnest(['.env.example', 'package.json', 'prisma/schema.prisma', 'src/middleware.ts', 'src/auth.ts', '.i18nrc.js', 'pnpm-lock.yaml', 'tsconfig.json'])"""
_IMPORTED = f"SELECT file AS src, 'src/lib/m' || n || '.ts' AS dst FROM ({_C}) UNION SELECT file, 'src/lib/m' || n || '.ts' FROM ({_V})"
_F = "'src/lib/m' || {0} || '.ts::f' || {0} || '::5'"
_CALLED = f"""SELECT file || '::g' || k || '::8' AS src, {_F.format('k')} AS dst FROM ({_C}) UNION SELECT file || '::own' || k || '::9', file || '::g' || k || '::8' FROM ({_C})
UNION SELECT file || '::own' || k || '::9', {_F.format('n')} FROM ({_C}) UNION SELECT file || '::w::9', {_F.format('n')} FROM ({_V})"""


@register(
    f"""SELECT 'node' AS kind, label AS name, count(*) AS n FROM (SELECT 'File' AS label FROM ({_FILES}) UNION ALL SELECT 'File' FROM region UNION ALL SELECT unnest(['Function', 'Function', 'Function', 'Type', 'Type']) FROM customer
 UNION ALL SELECT unnest(['Function', 'Function', 'Component', 'Type']) FROM supplier UNION ALL SELECT unnest(['Hook', 'Hook', 'Module']) UNION ALL SELECT 'Module' FROM (SELECT DISTINCT c_nationkey FROM customer)
 UNION ALL SELECT unnest(['Route', 'Route']) FROM nation UNION ALL SELECT unnest(['Service', 'Store']) FROM region) GROUP BY label
UNION ALL SELECT 'edge', rel, count(*) FROM (SELECT 'IMPORTS' AS rel FROM ({_IMPORTED}) UNION ALL SELECT 'IMPORTS' FROM customer UNION ALL SELECT 'IMPORTS' FROM supplier UNION ALL SELECT 'DEFINES' FROM customer, range(5) UNION ALL SELECT 'DEFINES' FROM supplier, range(4)
 UNION ALL SELECT 'CALLS' FROM ({_CALLED}) UNION ALL SELECT 'USES_HOOK' FROM supplier, range(2) UNION ALL SELECT 'HAS_ROUTE' FROM nation, range(2) UNION ALL SELECT unnest(['BELONGS_TO', 'HAS_STORE']) FROM region) GROUP BY rel"""
)
def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).totals()


@register(f"SELECT 'CALLS' AS rel, src, dst FROM ({_CALLED}) UNION ALL SELECT 'IMPORTS', src, dst FROM ({_IMPORTED}) UNION ALL SELECT 'IMPORTS', file, 'pkg' || m FROM ({_C}) UNION ALL SELECT 'IMPORTS', file, 'react' FROM ({_V})")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).listing().where("rel in ('CALLS', 'IMPORTS')").select("rel", "src", "dst")


@register(
    f"""SELECT file || '::f' || k || '::5' AS key, 'f' || k AS name, 'function' AS kind, 5 AS line, true AS exported, 'false' AS is_async, 'a,b' AS params FROM ({_C}) UNION ALL SELECT file || '::g' || k || '::8', 'g' || k, 'arrow', 8, true, 'true', 'x' FROM ({_C})
UNION ALL SELECT file || '::own' || k || '::9', 'own' || k, 'function', 9, false, 'false', '' FROM ({_C}) UNION ALL SELECT file || '::S' || k || '::7', 'S' || k, 'function', 7, true, 'false', '' FROM ({_V}) UNION ALL SELECT file || '::w::9', 'w', 'arrow', 9, false, 'false', '' FROM ({_V})"""
)
def function_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).nodes.where("label = 'Function'").select("key", "name", "kind", "line", "exported", F.col("properties")["is_async"].alias("is_async"), F.col("properties")["params"].alias("params"))


@register("SELECT '/n' || n_nationkey AS key, 'page' AS type, NULL AS methods FROM nation UNION ALL SELECT '/api/n' || n_nationkey, 'api', 'GET,POST' FROM nation")
def route_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).nodes.where("label = 'Route'").select("key", F.col("properties")["type"].alias("type"), F.col("properties")["methods"].alias("methods"))


@register("SELECT 'r' || r_regionkey AS key, 'auth' AS slices, 'persist' AS middleware FROM region")
def store_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).nodes.where("label = 'Store'").select("key", F.col("properties")["slices"].alias("slices"), F.col("properties")["middleware"].alias("middleware"))


@register("SELECT 'Region' || r_regionkey || 'Service' AS key, 'run' || r_regionkey || ',key' || r_regionkey AS exported_functions FROM region")
def service_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).nodes.where("label = 'Service'").select("key", F.col("properties")["exported_functions"].alias("exported_functions"))


@register("SELECT NULL::VARCHAR AS label, NULL::VARCHAR AS key, NULL::BIGINT AS n WHERE false")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Must be empty: every node has a key of its own."""
    return graph.duplicate_keys(_built(spark, d).nodes)


@register(f"SELECT 'own1' AS name, callee, file FROM (SELECT 'g1' AS callee, 'src/lib/m1.ts' AS file UNION SELECT 'f' || n, 'src/lib/m' || n || '.ts' FROM ({_C}) WHERE k = 1)")
def callees_of_function(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("Function",), ("CALLS",)).callees("own1")


@register(f"SELECT {_F.format('n')} AS key, 'f' || n AS name, 'src/lib/m' || n || '.ts' AS file, c AS callers FROM (SELECT n, count(*) AS c FROM (SELECT DISTINCT src, n FROM (SELECT file || '::own' AS src, n FROM ({_C}) UNION ALL SELECT file || '::w', n FROM ({_V}) UNION ALL SELECT file || '::g', k FROM ({_C}))) GROUP BY n) WHERE c > 5 ORDER BY callers DESC, key LIMIT 10")
def most_called_functions(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("Function",), ("CALLS",)).most_called()


@register(
    f"""WITH e AS ({_IMPORTED}), p1 AS (SELECT src AS a, dst AS b FROM e WHERE src = 'src/components/S1.tsx'), p2 AS (SELECT a, b, dst AS c FROM p1 JOIN e ON src = b), p3 AS (SELECT a, b, c, dst AS x FROM p2 JOIN e ON src = c WHERE NOT (src = b AND dst = c))
SELECT a || '>' || b AS path, 1 AS length FROM p1 UNION ALL SELECT a || '>' || b || '>' || c, 2 FROM p2 UNION ALL SELECT a || '>' || b || '>' || c || '>' || x, 3 FROM p3"""
)
def import_chains(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, (), ("IMPORTS",)).import_chains("src/components/S1.tsx", most=None).select(F.array_join("nodes", ">").alias("path"), "length")


@register(
    f"""WITH RECURSIVE e AS ({_IMPORTED}), w(start, path, last, n) AS (SELECT src, src || '>' || dst, dst, 1 FROM e WHERE src LIKE 'src/lib/%' UNION ALL SELECT start, path || '>' || dst, dst, n + 1 FROM w JOIN e ON src = last WHERE n < 5 AND last <> start AND src <> dst)
SELECT path AS cycle, n AS length FROM w WHERE last = start AND n >= 2"""
)
def circular_imports(spark: SparkSession, d: str) -> DataFrame:
    # each module imports one other, so a closed path of different edges meets no file twice
    return _graph(spark, d, (), ("IMPORTS",)).circular_imports(most=None).select(F.array_join("nodes", ">").alias("cycle"), "length")


@register(f"SELECT file AS path FROM ({_FILES}) WHERE file NOT IN (SELECT src FROM ({_IMPORTED})) UNION ALL SELECT 'src/store/r' || r_regionkey FROM region")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("File",), ("IMPORTS",)).orphan_files()


@register("SELECT 'src/app/api/n' || n_nationkey || '/route.ts' AS path, '/api/n' || n_nationkey AS route, 'GET,POST' AS methods FROM nation")
def routes_under_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("File", "Route"), ("HAS_ROUTE",)).routes_under("src/app/api/")


def _with_app(spark: SparkSession, d: str) -> graph.Graph:
    """A graph of the app's files alone, for questions about routes and stores."""
    files = app(spark, d)
    out = typescript.extract_files(files)
    rel = {x: typescript.relation(out, x) for x in schemas.AST}
    return graph.Graph(*graph.build(*(rel[x] for x in ("imports", "functions", "components", "types", "hooks", "calls")), routes=D.routes(files), stores=A.stores(files), files=files.select("path")))


@register("SELECT '/api/n' || n_nationkey AS route, unnest(['GET', 'POST']) AS name, unnest(['function', 'arrow']) AS kind, 'src/app/api/n' || n_nationkey || '/route.ts' AS path FROM nation")
def route_handlers(spark: SparkSession, d: str) -> DataFrame:
    return _with_app(spark, d).route_handlers()


@register("SELECT 'act1' AS name, 'function' AS kind, true AS exported, 2 AS line, 'src/store/r1/index.ts' AS file FROM region WHERE r_regionkey = 1")
def functions_of_store(spark: SparkSession, d: str) -> DataFrame:
    return _with_app(spark, d).functions_of_store("r1").where("name is not null and name like 'act%'")


@register("SELECT 'r' || r_regionkey AS store, 'act' || r_regionkey AS name, 'a' AS params, true AS exported, 'src/store/r' || r_regionkey || '/index.ts' AS file FROM region")
def store_usage(spark: SparkSession, d: str) -> DataFrame:
    return _with_app(spark, d).store_functions().where("name like 'act%'")


@register(f"SELECT module, count(*) AS files FROM (SELECT 'pkg' || m AS module FROM ({_C}) UNION ALL SELECT 'react' FROM ({_V})) GROUP BY 1 ORDER BY files DESC, module LIMIT 10")
def top_modules(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("File", "Module"), ("IMPORTS",)).modules(10)


@register("SELECT hook, 'Function' AS entity, count(*) AS n FROM (SELECT unnest(['useState', 'useMemo']) AS hook FROM supplier) GROUP BY hook")
def hook_usage_by_entity(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("Function", "Component", "Hook"), ("USES_HOOK",)).hook_usage()


@register(f"SELECT 'S' || k AS name, file, 2::BIGINT AS dependencies FROM ({_V})")
def busy_components(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("Component", "File"), ("DEFINES", "IMPORTS")).busy_components(1)


def _component_hooks(spark: SparkSession, d: str) -> graph.Graph:
    """Events as hook calls of users, who are components and no functions."""
    e = table(spark, d, "events")
    who = F.concat(F.lit("U"), _s("user_id"))
    hooks = e.select(F.lit("src/u.tsx").alias("file"), F.concat(F.lit("use"), F.initcap("event_type")).alias("name"), who.alias("caller"), F.lit(0).alias("args_count"), F.col("event_id").cast("int").alias("line"))
    comps = e.select(F.lit("src/u.tsx").alias("file"), who.alias("name")).distinct().select("file", "name", F.lit("class").alias("kind"), F.array().cast("array<string>").alias("props"), F.lit(True).alias("exported"), F.lit(1).alias("line"))
    none = {x: spark.createDataFrame([], schemas.AST[x]) for x in schemas.AST}
    return graph.Graph(*graph.build(none["imports"], none["functions"], comps, none["types"], hooks, none["calls"]))


_HOOK = "'use' || upper(event_type[1]) || event_type[2:]"


@register(f"SELECT 'src/u.tsx::U' || user_id AS key, 'U' || user_id AS name, string_agg(DISTINCT {_HOOK}, ',' ORDER BY {_HOOK}) AS hooks, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def hooks_collected(spark: SparkSession, d: str) -> DataFrame:
    return _component_hooks(spark, d).hooks_of_components().withColumn("hooks", F.array_join("hooks", ","))


@register("SELECT DISTINCT 'U' || user_id AS name, 'src/u.tsx' AS file FROM events WHERE event_type = 'click'")
def components_using_hook(spark: SparkSession, d: str) -> DataFrame:
    return _component_hooks(spark, d).components_using("useClick")


@register(f"SELECT n AS nation, count(*) AS importers FROM ({_C}) GROUP BY n")
def graph_sql(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT CAST(regexp_extract(dst, 'm([0-9]+)', 1) AS INT) AS nation, count(*) AS importers FROM {edges} WHERE rel = :rel AND dst_label = 'File' AND src LIKE 'src/lib/%' GROUP BY 1"
    return _graph(spark, d, (), ("IMPORTS",)).query(sql, rel="IMPORTS")


@register(f"SELECT file AS src, 'src/lib/m' || n || '.ts' AS dst FROM ({_C}) WHERE n > 0 UNION SELECT file, 'src/lib/m' || n || '.ts' FROM ({_V})")
def import_hops(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, ("File",), ("IMPORTS",)).hop("IMPORTS", "File", "File").select(F.col("a.key").alias("src"), F.col("b.key").alias("dst"))


@register(f"SELECT 'File' AS label, count(*) AS n FROM ({_FILES}) WHERE file NOT LIKE 'src/components/%' UNION ALL SELECT 'Module', count(DISTINCT c_nationkey) FROM customer")
def graph_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    nodes, _ = graph.delete_files(g.nodes, g.edges, views(spark, d).select("path"))
    return nodes.where("label = 'Module' or (label = 'File' and not (key like 'src/store/r%' and key not like '%.ts'))").groupBy("label").agg(F.count("*").alias("n"))


@register(f"SELECT file AS path FROM ({_C}) WHERE k = 3 UNION SELECT file FROM ({_C}) WHERE n = 3 UNION SELECT file FROM ({_V}) WHERE n = 3")
def affected_by_import(spark: SparkSession, d: str) -> DataFrame:
    rel = _extracted(spark, d)
    files = modules(spark, d).unionByName(views(spark, d)).select("path")
    changed = files.where("path = 'src/lib/m3.ts'")
    return sync.affected(changed, graph.resolve_imports(rel["imports"], files), rel["calls"], rel["functions"])


# chunks, vectors ----------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rel = _extracted(spark, d)
    return chunks.create(rel["functions"], rel["components"], rel["types"], rel["imports"], modules(spark, d).unionByName(views(spark, d)))


@register(
    f"""WITH c AS ({_C}), v AS ({_V}), x AS (SELECT file, 'function' AS chunk_type, unnest(['f' || k, 'g' || k, 'own' || k]) AS name, unnest([5, 8, 9]) AS line, unnest([8, 5, 4]) AS lines, unnest([true, true, false]) AS exported, 4 AS deps, 12 AS total FROM c
 UNION ALL SELECT file, 'type', unnest(['T' || k, 'I' || k]), unnest([10, 11]), unnest([3, 2]), unnest([true, false]), 4, 12 FROM c UNION ALL SELECT file, 'function', unnest(['S' || k, 'w']), unnest([7, 9]), unnest([5, 3]), unnest([true, false]), 2, 11 FROM v
 UNION ALL SELECT file, 'component', 'S' || k, 7, 5, true, 2, 11 FROM v UNION ALL SELECT file, 'type', 'S' || k || 'Props', 3, 9, false, 2, 11 FROM v)
SELECT file || ':' || chunk_type || ':' || name || ':' || line AS id, chunk_type, name, line, exported, CAST(lines AS INT) AS line_count, CAST(deps AS INT) AS dependencies, CASE WHEN file LIKE '%.tsx' THEN 'tsx' ELSE 'typescript' END AS language FROM x"""
)
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", "chunk_type", "name", "line", "exported", "line_count", F.size("dependencies").alias("dependencies"), "language")


@register("SELECT 'function' AS chunk_type, (SELECT 3 * count(*) FROM customer) + (SELECT 2 * count(*) FROM supplier) AS n UNION ALL SELECT 'component', count(*) FROM supplier UNION ALL SELECT 'type', (SELECT 2 * count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def chunk_types(spark: SparkSession, d: str) -> DataFrame:
    return chunks.by_type(_chunks(spark, d))


@register(f"SELECT file, 'T' || k AS name FROM ({_C}) WHERE k = 1")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts embedded by hashing: a chunk's own text is nearest to it."""
    rows = embedding.index(_chunks(spark, d).where("chunk_type = 'type' and exported"))
    query = "export interface T1 { id: string; name: string }\ntype I1 = string\nexport { own1 as out1 }"
    return search.search_code(rows, embedding.hashing([query])[0].tolist(), 1, search.Filters(chunk_type="type", exported_only=True, min_lines=10, max_lines=10)).select("file", "name")


# detectors ----------------------------------------------------------------------------


@register("SELECT 'Next.js' AS framework, 'TypeScript' AS language, false AS app_router, '15.1.0' AS next_version, 'pnpm' AS package_manager")
def detect_framework(spark: SparkSession, d: str) -> DataFrame:
    return D.framework(app(spark, d))


@register("SELECT '/n' || n_nationkey AS route, 'page' AS type, 'src/app/(main)/n' || n_nationkey || '/page.tsx' AS file, NULL AS slot, NULL AS methods, NULL AS tier FROM nation UNION ALL SELECT '/api/n' || n_nationkey, 'api', 'src/app/api/n' || n_nationkey || '/route.ts', NULL, 'GET,POST', NULL FROM nation")
def detect_routes(spark: SparkSession, d: str) -> DataFrame:
    return D.routes(app(spark, d)).withColumn("methods", F.array_join("methods", ","))


@register("SELECT 'S' || s_suppkey AS name, 'src/components/S' || s_suppkey || '.tsx' AS file, 0 AS position, 'id,label' AS props FROM supplier UNION ALL SELECT 'Page' || n_nationkey, 'src/app/(main)/n' || n_nationkey || '/page.tsx', 0, '' FROM nation")
def detect_components(spark: SparkSession, d: str) -> DataFrame:
    return A.components(views(spark, d).unionByName(app(spark, d))).withColumn("props", F.array_join("props", ","))


@register("SELECT 'Region' || r_regionkey || 'Service' AS service, 'src/services/region' || r_regionkey || '.service.ts' AS file, 'run' || r_regionkey || ',key' || r_regionkey AS exported_functions FROM region")
def detect_services(spark: SparkSession, d: str) -> DataFrame:
    return D.services(app(spark, d)).withColumn("exported_functions", F.array_join("exported_functions", ","))


@register("SELECT 'Prisma' AS orm, 'prisma/schema.prisma' AS schema, 'N' || n_nationkey AS model, 'id,name' || n_nationkey AS fields FROM nation")
def detect_database(spark: SparkSession, d: str) -> DataFrame:
    return A.database(app(spark, d)).select("orm", "schema", F.explode("models").alias("m")).select("orm", "schema", F.col("m.name").alias("model"), F.array_join("m.fields", ",").alias("fields"))


@register("SELECT 'next' AS framework, '@radix-ui' AS ui, 'prisma' AS database, 'zustand' AS state, false AS feature_flags")
def detect_packages(spark: SparkSession, d: str) -> DataFrame:
    return A.packages(app(spark, d)).select("framework", *[F.array_join(c, ",").alias(c) for c in ("ui", "database", "state")], "feature_flags")


@register("SELECT 'package.json' AS file, 'dependencies' AS section, 'pkg-r' || r_regionkey AS package, '1.' || r_regionkey || '.0' AS version FROM region UNION ALL SELECT 'package.json', unnest(['dependencies', 'dependencies', 'dependencies', 'devDependencies']), unnest(['next', '@radix-ui/x', 'prisma', 'zustand']), unnest(['15.1.0', '1', '6', '5'])")
def package_versions(spark: SparkSession, d: str) -> DataFrame:
    return sources.packages(app(spark, d)).withColumn("version", S.clean_version("version"))


@register("SELECT 'r' || r_regionkey AS store, 'src/store/r' || r_regionkey AS path, 'auth' AS slices, 'persist' AS middleware FROM region")
def detect_stores(spark: SparkSession, d: str) -> DataFrame:
    return A.stores(app(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("slices", "middleware")})


@register("SELECT 'lambda' AS tier, 'r' || r_regionkey AS router, 'src/server/routers/lambda/r' || r_regionkey || '.ts' AS file, 'list' || r_regionkey AS procedures FROM region")
def detect_trpc(spark: SparkSession, d: str) -> DataFrame:
    # "add" is followed by a call before its mutation, which the pattern does not span
    return A.trpc_routers(app(spark, d)).withColumn("procedures", F.array_join("procedures", ","))


@register("SELECT 'en' AS source_lang, (SELECT string_agg('l' || r_regionkey, ',' ORDER BY 'l' || r_regionkey) FROM region) AS target_langs, (SELECT string_agg('ns' || r_regionkey, ',' ORDER BY 'ns' || r_regionkey) FROM region) AS namespaces, (SELECT count(*)::INT FROM region) AS namespace_count, 'en-US' AS generated_langs, '.i18nrc.js' AS config_file")
def detect_i18n(spark: SparkSession, d: str) -> DataFrame:
    return A.i18n(app(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("target_langs", "namespaces", "generated_langs")})


@register("SELECT 'next-auth' AS providers, 'jwt' AS session_strategy, 'src/middleware.ts' AS middleware_file, (SELECT string_agg('/r' || r_regionkey, ',' ORDER BY '/r' || r_regionkey) FROM region) AS middleware_matchers, '' AS auth_routes, 'src/auth.ts' AS config_file, (SELECT string_agg('sso' || r_regionkey, ',' ORDER BY 'sso' || r_regionkey) FROM region) AS sso_providers")
def detect_auth(spark: SparkSession, d: str) -> DataFrame:
    return A.auth(app(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("providers", "middleware_matchers", "auth_routes", "sso_providers")})


@register("SELECT 'M' || r_regionkey AS module, 'src/server/modules/M' || r_regionkey AS path, 'index.ts' AS files, 'Mod' || r_regionkey || ',run' || r_regionkey AS exports FROM region")
def detect_server_modules(spark: SparkSession, d: str) -> DataFrame:
    return A.server_modules(app(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("files", "exports")})


@register("SELECT 'p' || r_regionkey AS provider, 'src/libs/agent-runtime/p' || r_regionkey AS path, 'streaming,vision' AS capabilities FROM region")
def detect_llm_providers(spark: SparkSession, d: str) -> DataFrame:
    return A.llm_providers(app(spark, d)).withColumn("capabilities", F.array_join("capabilities", ","))


@register("SELECT 'sso' || r_regionkey AS provider FROM region")
def detect_sso_providers(spark: SparkSession, d: str) -> DataFrame:
    return A.sso_providers(app(spark, d))


@register("SELECT '.env.example' AS file, (row_number() OVER (ORDER BY name) - 1)::INT AS position, name, CASE WHEN name LIKE 'OPENAI%' THEN 'LLM' WHEN name LIKE 'CLERK%' THEN 'AUTH' ELSE 'OTHER' END AS category FROM (SELECT CASE r_regionkey % 3 WHEN 0 THEN 'OPENAI_' WHEN 1 THEN 'CLERK_' ELSE 'ZZ_' END || replace(r_name, ' ', '_') AS name FROM region)")
def detect_env_vars(spark: SparkSession, d: str) -> DataFrame:
    return D.env_vars(app(spark, d))


@register("SELECT 'useN' || n_nationkey AS name, 'src/hooks/useN' || n_nationkey || '.ts' AS file, 'a,b' AS parameters FROM nation")
def detect_hooks(spark: SparkSession, d: str) -> DataFrame:
    return D.hooks(app(spark, d)).withColumn("parameters", F.array_join("parameters", ","))


@register("SELECT 's' || r_regionkey AS name, 'scripts/s' || r_regionkey || '.ts' AS path, 'file' AS type, '' AS files FROM region UNION ALL SELECT 'd' || r_regionkey, 'scripts/d' || r_regionkey, 'dir', 'a.ts' FROM region")
def detect_scripts(spark: SparkSession, d: str) -> DataFrame:
    return D.scripts(app(spark, d)).withColumn("files", F.array_join("files", ","))


@register("SELECT 'l' || r_regionkey AS lib, 'src/libs/l' || r_regionkey AS path, 'x.ts' AS main_files FROM region UNION ALL SELECT unnest(['agent-runtime', 'next-auth']), unnest(['src/libs/agent-runtime', 'src/libs/next-auth']), ''")
def detect_libs(spark: SparkSession, d: str) -> DataFrame:
    return D.libs(app(spark, d)).withColumn("main_files", F.array_join("main_files", ","))


@register("SELECT true AS has_src_prefix, 'locales,prisma,scripts,src' AS root_dirs, '.env.example' AS env_files, 'src/components/' AS components, 'package.json' AS package_json, '.i18nrc.js' AS i18n_config, (SELECT count(*)::INT FROM region) AS total_vars")
def detect_structure(spark: SparkSession, d: str) -> DataFrame:
    out = A.structure(views(spark, d).unionByName(app(spark, d)))
    return out.select("has_src_prefix", F.array_join("root_dirs", ",").alias("root_dirs"), F.array_join("env_files", ",").alias("env_files"), F.col("src_structure")["components"].alias("components"), F.col("config_files")["package_json"].alias("package_json"), F.col("config_files")["i18n_config"].alias("i18n_config"), F.col("env_summary.total_vars").alias("total_vars"))


@register("WITH r AS (SELECT count(*) AS r FROM region), n AS (SELECT count(*) AS n FROM nation) SELECT 'Next.js' AS framework, 'Prisma' AS database, 2 * n AS routes_count, n AS components_count, r AS services_count, r AS stores_count, r AS trpc_procedures_count, n AS hooks_count, 2 * r AS scripts_count, r + 2 AS libs_count FROM r, n")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return scanner.summarize(scanner.scan_repository(app(spark, d))).select("framework", "database", "routes_count", "components_count", "services_count", "stores_count", "trpc_procedures_count", "hooks_count", "scripts_count", "libs_count")


# change sets and merges -----------------------------------------------------------------

_KIND = "c_custkey % 4"


@register(f"SELECT unnest(CASE {_KIND} WHEN 0 THEN ['a' || c_custkey || '.ts', 'b' || c_custkey || '.tsx'] ELSE ['a' || c_custkey || '.ts'] END) AS path, unnest(CASE {_KIND} WHEN 0 THEN ['deleted', 'changed'] WHEN 1 THEN ['deleted'] ELSE ['changed'] END) AS op FROM customer WHERE {_KIND} < 3")
def status_lines(spark: SparkSession, d: str) -> DataFrame:
    k, kind = _s("c_custkey"), F.expr(_KIND)
    line = F.when(kind == 0, _text("R  a{k}.ts -> b{k}.tsx", k=k)).when(kind == 1, _text(" D a{k}.ts", k=k)).when(kind == 2, _text('?? "a{k}.ts"', k=k)).otherwise(_text(" M a{k}.md", k=k))
    return sources.status_changes(table(spark, d, "customer").select(line.alias("value")))


@register(f"SELECT unnest(CASE {_KIND} WHEN 0 THEN ['a' || c_custkey || '.ts', 'b' || c_custkey || '.tsx'] ELSE ['a' || c_custkey || '.ts'] END) AS path, unnest(CASE {_KIND} WHEN 0 THEN ['deleted', 'changed'] WHEN 1 THEN ['deleted'] ELSE ['changed'] END) AS op FROM customer WHERE {_KIND} < 3")
def name_status_lines(spark: SparkSession, d: str) -> DataFrame:
    k, kind = _s("c_custkey"), F.expr(_KIND)
    line = F.when(kind == 0, _text("R100\ta{k}.ts\tb{k}.tsx", k=k)).when(kind == 1, _text("D\ta{k}.ts", k=k)).when(kind == 2, _text("M\ta{k}.ts", k=k)).otherwise(_text("A\ta{k}.md", k=k))
    return sources.name_status_changes(table(spark, d, "customer").select(line.alias("value")))


@register("SELECT 'src/n' || c_nationkey || '/c' || c_custkey AS path, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'new' ELSE 'old' END AS state FROM customer UNION ALL SELECT 'src/n' || n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)) THEN 'new' ELSE 'old' END FROM nation")
def merge_by_folder(spark: SparkSession, d: str) -> DataFrame:
    folder = lambda c: F.concat(F.lit("src/n"), _s(c))
    c = table(spark, d, "customer")
    path = F.concat(folder("c_nationkey"), F.lit("/c"), _s("c_custkey"))
    rows = c.select(path.alias("path")).union(table(spark, d, "nation").select(folder("n_nationkey")))
    near = c.join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi")
    changed = near.select(path.alias("path"))
    return sync.merge(rows.withColumn("state", F.lit("old")), rows.withColumn("state", F.lit("new")), changed, "path", by_prefix=True)


@register("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS state FROM orders UNION ALL SELECT -1 - c_custkey, 'new' FROM customer")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.lit("old").alias("state"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).union(table(spark, d, "customer").select(-1 - F.col("c_custkey"))).withColumn("state", F.lit("new"))
    return sync.upsert(old, new, ["id"])


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_event_of_each(spark: SparkSession, d: str) -> DataFrame:
    return sync.first_of_each(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@register("SELECT DISTINCT p_brand AS key FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49)")
def unused_nodes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey")
    e = graph.edges(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "USES", "Line", _s("l_partkey"), "Brand", F.col("p_brand"))
    return graph.unused(part.select(F.lit("Brand").alias("label"), F.col("p_brand").alias("key")).distinct(), e, "Brand").select("key")


@register("SELECT path FROM (SELECT 'src/n' || n_nationkey || '/a.TSX' AS path FROM nation UNION ALL SELECT 'src/r' || r_regionkey || '.ts' FROM region)")
def typescript_files(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(_text("src/n{k}/a.TSX", k=_s("n_nationkey")).alias("path"))
    r = table(spark, d, "region").select(F.explode(F.array(_text("src/r{k}.ts", k=_s("r_regionkey")), _text("src/r{k}.js", k=_s("r_regionkey")))).alias("path"))
    return sources.typescript(n.union(r))
