"""The property graph as node and edge tables: builders, resolution joins, patterns, deletion.

What only some labels have (route type, methods, parameters, ...) lies in ``properties``, a map of strings with lists
joined by commas. Keys are unique within a label: of several rows the last wins, by the order of relations, then file and line.

Both sides of a join grow with the repository, so joins sort: Spark judges a table by its files, and in these millions of
alike paths take a few MB, which it would broadcast from the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import merged

PROPERTIES = "map<string,string>"
NODE_COLUMNS = ["label", "key", "file", "name", "kind", "line", "exported", "properties"]
EDGE_COLUMNS = ["rel", "src_label", "src", "dst_label", "dst"]
#: Suffixes tried for an import, in order (fixed values).
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _nodes(rows: DataFrame, label: str, key: Column, properties: dict[str, str] | None = None, **columns: Column) -> DataFrame:
    kinds = {"line": "int", "exported": "boolean"}
    given = [(n, c) for n, c in (properties or {}).items() if c in rows.columns]
    text = lambda c: F.array_join(c, ",") if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string")
    pairs = F.to_json(F.struct(*[text(c).alias(n) for n, c in given])) if given else F.lit("{}")  # leaves out what is null
    return rows.select(F.lit(label).alias("label"), key.alias("key"), *[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in NODE_COLUMNS[2:-1]], F.from_json(pairs, PROPERTIES).alias("properties"))


def last_wins(parts: list[DataFrame]) -> DataFrame:
    """One node a label and key, the last by the order of ``parts``, file and line."""
    rows = reduce(lambda a, b: a.unionByName(b), [x.withColumn("_part", F.lit(i)) for i, x in enumerate(parts)])
    rest = F.struct(*NODE_COLUMNS[2:])
    return rows.groupBy("label", "key").agg(F.max_by(rest, F.struct("_part", "file", "line", "name", "kind", "exported")).alias("r")).select("label", "key", "r.*")


def matched(edges_: DataFrame, nodes: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges both of whose ends are nodes; the others are dropped."""
    for end in ends:
        at = nodes.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(end))
        edges_ = edges_.join(merged(at), [f"{end}_label", end], "left_semi")
    return edges_.select(*EDGE_COLUMNS)


def with_endpoints(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes, and a bare node for each end of an edge that is none yet."""
    ends = edges_.select(F.col("src_label").alias("label"), F.col("src").alias("key")).union(edges_.select("dst_label", "dst")).distinct()
    missing = ends.join(merged(nodes), ["label", "key"], "left_anti")
    return nodes.unionByName(missing.withColumn("properties", F.from_json(F.lit("{}"), PROPERTIES)), allowMissingColumns=True)


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """(label, key, n) of keys that are not unique; empty for what :func:`build` returns."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def edges(rows: DataFrame, rel: str, src_label: str | Column, src: Column, dst_label: str, dst: Column) -> DataFrame:
    lab = F.lit(src_label) if isinstance(src_label, str) else src_label
    return rows.select(F.lit(rel).alias("rel"), lab.alias("src_label"), src.alias("src"), F.lit(dst_label).alias("dst_label"), dst.alias("dst")).distinct()


def function_id() -> Column:
    return F.concat_ws("::", "file", "name", F.col("line").cast("string"))


def component_id() -> Column:
    return F.concat_ws("::", "file", "name")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative and ``@/`` or ``~/`` imports to the first existing candidate (exact, suffixes, index files)."""
    base = F.when(F.col("source").rlike(r"^[@~]/"), F.concat(F.lit("src/"), F.expr("substring(source, 3)"))).otherwise(F.concat_ws("/", S.parent("file"), "source"))
    local = imports.where(F.col("source").rlike(r"^(\.{1,2}/|[@~]/|\.{1,2}$)"))
    steps = F.aggregate(F.split(base, "/"), F.array().cast("array<string>"), lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    tried = local.withColumn("_base", F.array_join(steps, "/"))
    tried = tried.select("file", "source", "_base", F.posexplode(F.array(*[F.lit(x) for x in SUFFIXES])).alias("_rank", "_suffix")).withColumn("path", F.concat("_base", "_suffix"))
    hit = tried.join(merged(files.select("path").distinct()), "path")
    return hit.groupBy("file", "source").agg(F.min_by("path", "_rank").alias("target"))


def resolve_caller(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """As-of join: of the functions with the call's file and caller name, the last that begins at or before the call."""
    defs = functions.where("name is not null").select(F.col("file").alias("f"), F.col("name").alias("n"), F.col("line").alias("def_line"), function_id().alias("caller_id"))
    hit = calls.join(merged(defs), (calls["file"] == defs["f"]) & (calls["caller"] == defs["n"]) & (defs["def_line"] <= calls["line"]))
    return hit.groupBy(*calls.columns).agg(F.max_by("caller_id", "def_line").alias("caller_id"))


def resolve_callee(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Priority join: a definition in the calling file first (least line), else that of the first file by name."""
    defs = functions.where("name is not null").select(F.col("file").alias("f"), F.col("name").alias("n"), F.col("line").alias("def_line"), function_id().alias("callee_id"))
    # the only candidates are the least (line) in each file and the least (file, line) of all
    own = defs.groupBy("f", "n").agg(F.min_by("callee_id", "def_line").alias("own_id"))
    any_ = defs.groupBy(F.col("n").alias("m")).agg(F.min_by("callee_id", F.struct("f", "def_line")).alias("any_id"))
    out = calls.join(merged(own), (calls["file"] == own["f"]) & (calls["callee"] == own["n"]), "left").join(merged(any_), calls["callee"] == any_["m"], "left")
    return out.withColumn("callee_id", F.coalesce("own_id", "any_id")).where("callee_id is not null").select(*calls.columns, "callee_id")


def build(imports: DataFrame, functions: DataFrame, components: DataFrame, types: DataFrame, hooks: DataFrame, calls: DataFrame, routes: DataFrame | None = None, services: DataFrame | None = None, stores: DataFrame | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository's relations. Edges are a set; the last row of a key wins."""
    named = functions.where("name is not null")
    seen = reduce(lambda a, b: a.union(b), [x.select(F.col("file").alias("path")) for x in (functions, components, types, hooks, imports)]).distinct()
    files = seen if files is None else files.select("path").union(seen).distinct()
    resolved = resolve_imports(imports, files)
    package = imports.where((F.col("import_kind") == "external") | ((F.col("import_kind") == "alias") & ~F.col("source").rlike(r"^[@~]/")))
    defined = hooks.select("name").distinct().join(merged(named.select("name", "file", "line")), "name").groupBy("name").agg(F.max_by("file", F.struct("file", "line")).alias("file"))
    whole = {c: F.col(c) for c in ("file", "name", "kind", "line", "exported")}
    nodes = [
        _nodes(files, "File", F.col("path")),
        _nodes(named, "Function", function_id(), {"is_async": "async", "params": "params"}, **whole),
        _nodes(components, "Component", component_id(), {"props": "props"}, **whole),
        _nodes(types, "Type", function_id(), {"members": "members"}, **whole),
        _nodes(hooks.select("name").distinct(), "Hook", F.col("name"), name=F.col("name")),
        _nodes(package.select("source").distinct(), "Module", F.col("source"), name=F.col("source")),
    ]
    called = resolve_callee(resolve_caller(calls, functions), functions)
    used = hooks.where("caller is not null").select("file", "caller", "line", F.col("name").alias("hook"))
    by_function = resolve_caller(used, functions)
    comps = components.select(F.col("file").alias("f"), F.col("name").alias("n"), component_id().alias("component")).distinct()
    using = used.join(merged(by_function), used.columns, "left").join(merged(comps), (F.col("file") == F.col("f")) & (F.col("caller") == F.col("n")), "left").where("caller_id is not null or component is not null")
    rel = [
        edges(resolved, "IMPORTS", "File", F.col("file"), "File", F.col("target")),
        edges(package, "IMPORTS", "File", F.col("file"), "Module", F.col("source")),
        edges(named, "DEFINES", "File", F.col("file"), "Function", function_id()),
        edges(components, "DEFINES", "File", F.col("file"), "Component", component_id()),
        edges(types, "DEFINES", "File", F.col("file"), "Type", function_id()),
        edges(defined, "DEFINES", "File", F.col("file"), "Hook", F.col("name")),
        edges(called, "CALLS", "Function", F.col("caller_id"), "Function", F.col("callee_id")),
        edges(using, "USES_HOOK", F.when(F.col("caller_id").isNotNull(), "Function").otherwise("Component"), F.coalesce("caller_id", "component"), "Hook", F.col("hook")),
    ]
    kept = {"Route": {"type": "type", "methods": "methods", "tier": "tier", "slot": "slot"}, "Service": {"exported_functions": "exported_functions"}, "Store": {"slices": "slices", "middleware": "middleware"}}
    for rows, label, key, name in ((routes, "Route", "route", "HAS_ROUTE"), (services, "Service", "service", "BELONGS_TO"), (stores, "Store", "store", "HAS_STORE")):
        if rows is not None:
            rows = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
            owner = F.col("path" if "path" in rows.columns else "file")
            nodes.append(_nodes(rows, label, F.col(key), kept[label], name=F.col(key), file=owner))
            of_file = edges(rows, name, "File", owner, label, F.col(key))
            if label == "Store":  # hangs on a folder, which becomes a File node
                nodes.append(_nodes(rows.select(owner.alias("p")).distinct(), "File", F.col("p")))
            else:
                of_file = matched(of_file, nodes[0], ("src",))
            rel.append(of_file)
    return last_wins(nodes), reduce(lambda a, b: a.unionByName(b), rel)


def degree(edges_: DataFrame, end: str, more_than: int = 0) -> DataFrame:
    return edges_.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def _trails(edges_: DataFrame, start: Column, longest: int) -> list[DataFrame]:
    """For each number of edges up to ``longest`` the paths with no edge twice: (nodes, last, taken)."""
    e = edges_.select("src", "dst", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("edge")).distinct()
    now = e.where(start).select(F.array("src", "dst").alias("nodes"), F.col("dst").alias("last"), F.array("edge").alias("taken"))
    out = [now]
    for _ in range(longest - 1):
        now = now.join(merged(e), (F.col("last") == F.col("src")) & ~F.array_contains("taken", F.col("edge")))
        now = now.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("last"), F.concat("taken", F.array("edge")).alias("taken"))
        out.append(now)
    return out


def paths(edges_: DataFrame, start: Column, longest: int) -> DataFrame:
    """Paths of 1 to ``longest`` edges (src, dst) from the nodes of ``start``, no edge twice: (nodes, length).
    One join a step; the steps are a bounded number."""
    found = reduce(lambda a, b: a.union(b), _trails(edges_, start, longest))
    return found.select("nodes", (F.size("nodes") - 1).alias("length"))


def cycles(edges_: DataFrame, shortest: int = 2, longest: int = 5) -> DataFrame:
    """Closed paths with no edge twice, once for each node they can start at: (nodes, length).

    A cycle is two halves that meet at both ends, so only paths of half its length are made, and only
    of edges between nodes that have edges in and out; these are kept in the cache, as every step reads them."""
    e = edges_.select("src", "dst").distinct()
    e = e.join(merged(edges_.select(F.col("src").alias("x"))), F.col("dst") == F.col("x"), "left_semi").join(merged(edges_.select(F.col("dst").alias("x"))), F.col("src") == F.col("x"), "left_semi").persist()
    trails = _trails(e, F.lit(True), max(1, (longest + 1) // 2))
    found = [trails[0].where(F.col("nodes")[0] == F.col("last")).select("nodes")] if shortest <= 1 else []
    for n in range(max(2, shortest), longest + 1):
        a = trails[(n + 1) // 2 - 1].select(F.col("nodes").alias("head"), F.col("nodes")[0].alias("a"), F.col("last").alias("b"), F.col("taken").alias("t"))
        b = trails[n // 2 - 1].select("nodes", F.col("nodes")[0].alias("c"), F.col("last").alias("d"), "taken")
        both = a.join(merged(b), (F.col("b") == F.col("c")) & (F.col("a") == F.col("d")) & ~F.arrays_overlap("t", "taken"))
        found.append(both.select(F.concat("head", F.slice("nodes", 2, n // 2)).alias("nodes")))
    return reduce(lambda x, y: x.union(y), found).select("nodes", (F.size("nodes") - 1).alias("length"))


def orphans(nodes: DataFrame, edges_: DataFrame, key: str = "key") -> DataFrame:
    """Nodes without an edge in either direction."""
    return nodes.join(merged(edges_.select(F.col("src").alias(key))), key, "left_anti").join(merged(edges_.select(F.col("dst").alias(key))), key, "left_anti")


def unused(nodes: DataFrame, edges_: DataFrame, label: str) -> DataFrame:
    """Nodes of a label that no edge leads to."""
    into = edges_.where(F.col("dst_label") == label).select(F.col("dst").alias("key")).distinct()
    return nodes.where(F.col("label") == label).join(merged(into), "key", "left_anti")


def delete_files(nodes: DataFrame, edges_: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove files with what they define; modules and hooks go when nothing leads to them any more."""
    gone = files.select(F.lit("File").alias("label"), F.col("path").alias("key"))
    owned = edges_.where("rel = 'DEFINES' and dst_label != 'Hook'").join(merged(files.select(F.col("path").alias("src"))), "src", "left_semi").select(F.col("dst_label").alias("label"), F.col("dst").alias("key"))
    gone = gone.union(owned).distinct()
    left = edges_.join(merged(gone.select(F.col("label").alias("src_label"), F.col("key").alias("src"))), ["src_label", "src"], "left_anti")
    left = left.join(merged(gone.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"))), ["dst_label", "dst"], "left_anti").select(*EDGE_COLUMNS)
    rest = nodes.join(merged(gone), ["label", "key"], "left_anti").select(*nodes.columns)
    loose = unused(rest, left, "Module").unionByName(unused(rest, left, "Hook")).select("label", "key")
    return rest.join(merged(loose), ["label", "key"], "left_anti").select(*nodes.columns), left


def nested_calls(calls: DataFrame, order: str = "line") -> DataFrame:
    """file -> caller -> calls in order; callers by name, null last."""
    fields = [order, "callee", "kind", *(c for c in ("callee_object",) if c in calls.columns)]
    one = calls.groupBy("file", "caller").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("calls"))
    last = F.struct(F.col("caller").isNull().alias("last"), F.col("caller").alias("name"), F.col("calls"))
    return one.groupBy("file").agg(F.array_sort(F.collect_list(last)).alias("functions"))


def flat_calls(nested: DataFrame) -> DataFrame:
    one = nested.select("file", F.explode("functions").alias("f"))
    return one.select("file", F.col("f.name").alias("caller"), F.explode("f.calls").alias("c")).select("file", "caller", "c.*")


def numbered(rows: DataFrame, size: int, key: str, slices: int = 64) -> DataFrame:
    """Batches of ``size`` rows in order of a number, ``key``, without one task for all: rows are ranked within
    ``slices`` ranges of it, and counts of the ranges before are added. Equal keys are in no fixed order."""
    cuts = sorted(set(rows.approxQuantile(key, [i / slices for i in range(1, slices)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", F.coalesce(part, F.lit(-1)))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # at most ``slices``
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total)]
        total += counts[p]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    at = rank + F.create_map(*before)[F.col("_part")] if before else rank
    return ranged.withColumn("batch", F.floor(at / size)).drop("_part")


# patterns -------------------------------------------------------------------------


def hop(nodes: DataFrame, edges_: DataFrame, rel: str, src_label: str | None = None, dst_label: str | None = None, undirected: bool = False) -> DataFrame:
    """``(a)-[rel]->(b)``, or either way round if undirected: structs a and b, one row an edge."""
    e = edges_.where(F.col("rel") == rel).select(*EDGE_COLUMNS[1:])
    if undirected:
        e = e.union(e.select("dst_label", "dst", "src_label", "src")).distinct()
    held = [F.col(c) == v for c, v in (("src_label", src_label), ("dst_label", dst_label)) if v]
    e = e.where(reduce(and_, held)) if held else e
    node = lambda s: nodes.select(F.col("label").alias(f"{s}_l"), F.col("key").alias(f"{s}_k"), F.struct(*nodes.columns).alias(s))
    e = e.join(merged(node("a")), (F.col("src_label") == F.col("a_l")) & (F.col("src") == F.col("a_k")))
    return e.join(merged(node("b")), (F.col("dst_label") == F.col("b_l")) & (F.col("dst") == F.col("b_k"))).select("a", "b")


class Graph:
    """Documented questions to a graph. Each returns a DataFrame; ``query`` takes SQL over ``nodes`` and ``edges``."""

    def __init__(self, nodes: DataFrame, edges_: DataFrame):
        self.nodes, self.edges = nodes, edges_

    def query(self, sql: str, **parameters) -> DataFrame:
        """SQL in which {nodes} and {edges} stand for the tables and :name for a parameter."""
        return self.nodes.sparkSession.sql(sql, args=parameters or None, nodes=self.nodes, edges=self.edges)

    def rows(self, sql: str, **parameters) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.query(sql, **parameters).collect()]

    def hop(self, rel: str, src_label: str | None = None, dst_label: str | None = None, undirected: bool = False) -> DataFrame:
        return hop(self.nodes, self.edges, rel, src_label, dst_label, undirected)

    def callees(self, name: str) -> DataFrame:
        found = self.hop("CALLS", "Function", "Function").where(F.col("a.name") == name)
        return found.select(F.col("a.name").alias("name"), F.col("b.name").alias("callee"), F.col("b.file").alias("file"))

    def components_using(self, hook: str) -> DataFrame:
        return self.hop("USES_HOOK", "Component", "Hook").where(F.col("b.name") == hook).select("a.name", "a.file").orderBy("name", "file")

    def import_chains(self, path: str, longest: int = 3, most: int | None = 20) -> DataFrame:
        files = self.edges.where("rel = 'IMPORTS' and dst_label = 'File'")
        found = paths(files, F.col("src") == path, longest)
        return found if most is None else found.orderBy("length", "nodes").limit(most)

    def circular_imports(self, shortest: int = 2, longest: int = 5, most: int | None = 10) -> DataFrame:
        found = cycles(self.edges.where("rel = 'IMPORTS' and dst_label = 'File'"), shortest, longest)
        return found if most is None else found.orderBy("length", "nodes").limit(most)

    def orphan_files(self) -> DataFrame:
        return orphans(self.nodes.where("label = 'File'"), self.edges.where("rel = 'IMPORTS'")).select(F.col("key").alias("path"))

    def most_called(self, more_than: int = 5, most: int = 10) -> DataFrame:
        found = self.hop("CALLS", "Function", "Function").groupBy(F.col("b.key").alias("key"), F.col("b.name").alias("name"), F.col("b.file").alias("file")).agg(F.count("*").alias("callers"))
        return found.where(F.col("callers") > more_than).orderBy(F.desc("callers"), "key").limit(most)

    def routes_under(self, prefix: str) -> DataFrame:
        found = self.hop("HAS_ROUTE", "File", "Route").where(F.col("a.key").startswith(prefix))
        return found.select(F.col("a.key").alias("path"), F.col("b.key").alias("route"), F.col("b.properties")["methods"].alias("methods")).orderBy("route", "path")

    def _of_stores(self) -> DataFrame:
        """Functions of the files below a store's folder: each file's folders are joined with the stores' by equality."""
        folders = self.hop("HAS_STORE", "File", "Store").select(F.col("a.key").alias("folder"), F.col("b.key").alias("store"))
        parts = F.split("file", "/")
        parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        functions = self.nodes.where("label = 'Function'").withColumn("folder", F.explode(parents))
        return functions.join(folders, "folder")

    def functions_of_store(self, store: str) -> DataFrame:
        return self._of_stores().where(F.col("store") == store).select("name", "kind", "exported", "line", "file").orderBy("line", "file", "name")

    def store_functions(self) -> DataFrame:
        return self._of_stores().select("store", "name", F.col("properties")["params"].alias("params"), "exported", "file").orderBy("store", "name", "file")

    def modules(self, most: int | None = None) -> DataFrame:
        found = self.hop("IMPORTS", "File", "Module").groupBy(F.col("b.name").alias("module")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "module")
        return found if most is None else found.limit(most)

    def hook_usage(self) -> DataFrame:
        used = self.hop("USES_HOOK", dst_label="Hook")
        return used.groupBy(F.col("b.name").alias("hook"), F.col("a.label").alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hook", "entity")

    def route_handlers(self) -> DataFrame:
        route = self.hop("HAS_ROUTE", "Route", "File", undirected=True).where(F.col("a.properties")["type"] == "api")
        route = route.select(F.col("a.key").alias("route"), F.col("b.key").alias("path"))
        defined = self.hop("DEFINES", "File", "Function").where("b.exported").select(F.col("a.key").alias("path"), "b.name", "b.kind")
        return route.join(defined, "path").select("route", "name", "kind", "path").orderBy("route", "name")

    def busy_components(self, more_than: int = 10) -> DataFrame:
        owner = self.hop("DEFINES", "Component", "File", undirected=True).select("a.name", "a.file", F.col("b.key").alias("path"))
        imported = self.edges.where("rel = 'IMPORTS'").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("dependencies"))
        return owner.join(merged(imported), "path").where(F.col("dependencies") > more_than).select("name", "file", "dependencies").orderBy(F.desc("dependencies"), "name", "file")

    def hooks_of_components(self) -> DataFrame:
        used = self.hop("USES_HOOK", "Component", "Hook").groupBy(F.col("a.key").alias("key"), F.col("a.name").alias("name"))
        return used.agg(F.array_sort(F.collect_list("b.name")).alias("hooks"), F.count("*").alias("n")).orderBy(F.desc("n"), "key")

    def totals(self) -> DataFrame:
        """Nodes by label and edges by relation."""
        count = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
        return count(self.nodes, "node", "label").union(count(self.edges, "edge", "rel"))

    def listing(self, most: int | None = None) -> DataFrame:
        return self.edges if most is None else self.edges.orderBy(*EDGE_COLUMNS).limit(most)

    def cleared(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    def without(self, files: DataFrame) -> tuple[Graph, dict[str, int]]:
        """The graph without these files, and how many nodes and edges went."""
        nodes, left = delete_files(self.nodes, self.edges, files)
        size = lambda n, e: {"nodes": n.count(), "modules": n.where("label = 'Module'").count(), "edges": e.count()}
        before, after = size(self.nodes, self.edges), size(nodes, left)
        return Graph(nodes, left), {f"{k}_deleted": before[k] - after[k] for k in before}
