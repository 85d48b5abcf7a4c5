"""Detectors: what a repository is made of, from its files table (path, content).

Each takes the files of one repository as ``sources.files.scan`` gives them and returns a DataFrame.
Folders exist where files below them do. What a detector decides once (which candidate folder, which lock
file) is an ordered probe that aggregates to one row, however many files there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.files import first_existing

#: Dependencies that name a framework, in order of priority (fixed values).
FRAMEWORKS = (("next", "Next.js"), ("react", "React"), ("nuxt", "Nuxt"), ("vue", "Vue"))
#: Lock files and their package managers, the first that exists (fixed values).
LOCK_FILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("bun.lockb", "bun"))
#: Folders of the app router and the files that show that it is in use (fixed values).
APP_DIRS, APP_MARKERS = ("src/app", "app"), ("page.tsx", "page.jsx", "layout.tsx", "layout.jsx")
#: Examples of environment files, the first that exists (fixed values).
ENV_EXAMPLES = (".env.example", ".env.local.example", ".env.sample", ".env.template")
SCRIPT_DIRS, SCRIPT_SKIPPED = ("scripts", "script"), ("node_modules", "__pycache__", ".cache")
LIB_DIRS, LIB_SKIPPED, LIB_FILES = ("src/libs", "src/lib", "libs", "lib"), ("node_modules", "__pycache__", ".cache", "dist", "build"), 10
SERVICE_DIRS, HOOK_DIRS = ("services", "lib", "utils"), ("src/hooks", "hooks")
#: Exports in the source text (fixed values): classes, functions and constants, hooks with their parameters.
CLASS_EXPORT = r"export\s+(?:default\s+)?(?:abstract\s+)?class\s+([A-Z][A-Za-z0-9_]*)"
FUNCTION_EXPORT = r"export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*[(<]"
CONST_EXPORT = r"export\s+const\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*(?::[^=\n]+)?\s*="
HOOK_EXPORTS = (r"export\s+(?:default\s+)?(?:async\s+)?function\s+(use[A-Z][A-Za-z0-9_]*)\s*\(([^)]*)\)", r"export\s+const\s+(use[A-Z][A-Za-z0-9_]*)\s*(?::[^=\n]+)?\s*=\s*\(([^)]*)\)")
#: Parts of a path that tell the tier of an API route, the first that fits (fixed values).
TIERS = (("/lambda/", "lambda"), ("/async/", "async"), ("/edge/", "edge"), ("/webapi/", "webapi"), ("/(backend)/api/", "api"), ("/trpc/", "trpc"))


def _has(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _first(pairs: tuple, default: str | None, test) -> Column:
    """The value of the first key that passes the test."""
    return F.coalesce(*[F.when(test(k), v) for k, v in pairs], F.lit(default).cast("string"))


def below_first(files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """Files below the first of these folders that exists, with ``rest``, the path below it."""
    rank = F.coalesce(*[F.when(F.col("path").startswith(d + "/"), i) for i, d in enumerate(folders)])
    ranked = files.withColumn("rank", rank).where("rank is not null")
    best = F.broadcast(ranked.agg(F.min("rank").alias("best")))  # one row
    length = F.element_at(F.array(*[F.lit(len(d) + 2) for d in folders]), F.col("rank") + 1)
    return ranked.join(best, F.col("rank") == F.col("best")).withColumn("rest", F.substring("path", length, F.length("path"))).withColumn("root", F.element_at(F.array(*map(F.lit, folders)), F.col("rank") + 1))


def framework(files: DataFrame) -> DataFrame:
    """One row: framework, language, app_router, next_version, package_manager."""
    sections = [F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>") for s in ("dependencies", "devDependencies")]
    is_package = F.col("path") == "package.json"
    facts = files.agg(
        *[F.max(F.when(is_package, s)[k]).alias(f"{k}{i}") for k, _ in FRAMEWORKS for i, s in enumerate(sections)],
        _has(F.col("path").isin("tsconfig.json", "tsconfig.base.json")).alias("typed"),
        _has(F.col("path").isin(*[f"{d}/{m}" for d in APP_DIRS for m in APP_MARKERS])).alias("routed"),
        *[_has(F.col("path") == f).alias(m) for f, m in LOCK_FILES],
    )
    version = {k: F.coalesce(f"{k}1", f"{k}0") for k, _ in FRAMEWORKS}
    name = _first(FRAMEWORKS, "unknown", lambda k: version[k].isNotNull())
    managers = tuple((m, m) for _, m in LOCK_FILES)
    return facts.select(
        name.alias("framework"),
        F.when(F.col("typed"), "TypeScript").otherwise("JavaScript").alias("language"),
        (F.col("routed") & (name == "Next.js")).alias("app_router"),
        S.clean_version(version["next"]).alias("next_version"),
        _first(managers, "npm", F.col).alias("package_manager"),
    )


def routes(files: DataFrame) -> DataFrame:
    """(route, type, file, slot, methods, tier) of every page and API route; methods and tier of API routes only."""
    found = below_first(files, APP_DIRS).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin("page.tsx", "route.ts"))
    folder = F.regexp_replace(F.col("rest"), r"(^|/)[^/]+$", "")
    # exploded, so that no filter on a route repeats the fold inside its condition
    rows = found.select("path", "name", "content", F.explode(F.array(S.route_of(folder))).alias("r"))
    kind = F.when((F.col("r.type") == "page") & (F.col("name") == "route.ts"), "api").otherwise(F.col("r.type"))
    verbs = "|".join(S.METHODS)
    exported = [F.regexp_extract_all("content", F.lit(rf"export\s+{p}"), F.lit(1)) for p in (rf"(?:async\s+)?function\s+({verbs})\b", rf"const\s+({verbs})\s*=")]
    methods = S.canonical_methods(F.coalesce(F.concat(*exported), F.array().cast("array<string>")))
    api = kind == "api"
    tier = _first(TIERS, None, lambda k: F.col("path").contains(k))
    return rows.select(F.col("r.route").alias("route"), kind.alias("type"), F.col("path").alias("file"), F.col("r.slot").alias("slot"), F.when(api, methods).alias("methods"), F.when(api, tier).alias("tier"))


def env_vars(files: DataFrame) -> DataFrame:
    """(file, position, name, category) of each variable of the first example file, in the file's order."""
    lines = first_existing(files, list(ENV_EXAMPLES)).select(F.col("path").alias("file"), F.posexplode(F.split("content", S.LINE_ENDS)).alias("position", "line"))
    name = F.regexp_extract(F.trim("line"), r"^([A-Z][A-Z0-9_]*)(?:\s*=.*)?$", 1)
    return lines.select("file", "position", name.alias("name")).where("name != ''").withColumn("category", S.env_category("name"))


def scripts(files: DataFrame) -> DataFrame:
    """(name, path, type, files) of each file and folder directly below the scripts folder."""
    parts = F.split("rest", "/")
    rows = below_first(files, SCRIPT_DIRS).select("root", parts[0].alias("child"), F.size(parts).alias("depth"), F.get(parts, F.lit(1)).alias("inner"))
    rows = rows.where(~F.col("child").startswith(".") & ~F.col("child").isin(*SCRIPT_SKIPPED))
    direct = F.when((F.col("depth") == 2) & ~F.col("inner").startswith("."), F.col("inner"))
    found = rows.groupBy("root", "child").agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list(direct)).alias("files"))
    is_dir = F.col("depth") > 1
    name = F.when(is_dir, F.col("child")).otherwise(F.regexp_replace("child", r"(.)\.[^.]+$", "$1"))
    return found.select(name.alias("name"), F.concat_ws("/", "root", "child").alias("path"), F.when(is_dir, "dir").otherwise("file").alias("type"), "files")


def libs(files: DataFrame) -> DataFrame:
    """(lib, path, main_files) of each folder directly below the library folder; the report lists the first ten files by name."""
    parts = F.split("rest", "/")
    rows = below_first(files, LIB_DIRS).where(F.size(parts) > 1).select("root", parts[0].alias("lib"), F.size(parts).alias("depth"), parts[1].alias("inner"))
    rows = rows.where(~F.col("lib").startswith(".") & ~F.col("lib").isin(*LIB_SKIPPED))
    main = F.when((F.col("depth") == 2) & F.col("inner").rlike(r"[^.]\.tsx?$") & ~F.col("inner").startswith("_"), F.col("inner"))
    found = rows.groupBy("root", "lib").agg(F.slice(F.sort_array(F.collect_list(main)), 1, LIB_FILES).alias("main_files"))
    return found.select("lib", F.concat_ws("/", "root", "lib").alias("path"), "main_files")


def services(files: DataFrame) -> DataFrame:
    """(service, file, exported_functions) of each source file in the service folders: its first exported class,
    else its name in Pascal case; functions come before constants, each name once."""
    found = reduce(DataFrame.unionByName, [below_first(files, (f"src/{d}", d)) for d in SERVICE_DIRS]).where(F.col("path").rlike(r"[^/]\.tsx?$"))
    text = F.coalesce("content", F.lit(""))
    named = F.nullif(F.regexp_extract(text, CLASS_EXPORT, 1), F.lit(""))
    file_stem = F.regexp_extract("path", r"([^/]+)\.tsx?$", 1)
    exports = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (FUNCTION_EXPORT, CONST_EXPORT)]))
    return found.select(F.coalesce(named, S.pascal_case(file_stem)).alias("service"), F.col("path").alias("file"), exports.alias("exported_functions"))


def hooks(files: DataFrame) -> DataFrame:
    """(name, file, parameters) of each exported hook, where it is first seen: .ts before .tsx files, by path."""
    found = below_first(files, HOOK_DIRS).where(F.col("path").rlike(r"/[^_/][^/]*\.tsx?$"))

    def names(raw: Column) -> Column:
        bare = F.transform(F.split(raw, ","), lambda x: F.regexp_replace(F.trim(F.split(F.trim(x), r"[=:{\[]")[0]), r"^\.+", ""))
        return F.filter(bare, lambda x: x.rlike(r"^[a-zA-Z_$][\w$]*$"))

    def hits(pattern: str) -> Column:
        one = lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), names(F.regexp_extract(x, pattern, 2)).alias("parameters"))
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), one)

    rows = found.select("path", F.posexplode(F.concat(*map(hits, HOOK_EXPORTS))).alias("at", "hook"))
    seen = F.struct(F.col("path").endswith("x"), "path", "at")
    return rows.groupBy(F.col("hook.name").alias("name")).agg(F.min_by("path", seen).alias("file"), F.min_by("hook.parameters", seen).alias("parameters"))
