"""Detectors of an application's parts: layout, components, stores, routers, server code, translations, sign-in, packages, databases.

As in ``detectors``, each takes the files table (path, content) and returns a DataFrame. Those that describe
the repository as a whole give one row from one aggregation over the files; the others one row for each part.
What such a row lists are names of folders and files below a fixed place, never texts. Null content counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .detectors import below_first

#: Folders looked for below src, then at the root (fixed values).
SOURCE_DIRS = ("app", "components", "lib", "libs", "services", "hooks", "utils", "types", "store", "features", "db", "pages", "api", "styles", "public", "middleware", "config", "actions", "server", "trpc", "chains", "prompts", "tools", "icons", "font", "layout", "helpers", "migrations", "locales", "const", "database", "assets")
#: Configuration files by key, the first that exists (fixed values).
CONFIG_FILES = (
    ("package_json", ("package.json",)),
    ("tsconfig", ("tsconfig.json", "tsconfig.base.json")),
    ("next_config", ("next.config.ts", "next.config.mjs", "next.config.js")),
    ("drizzle_config", ("drizzle.config.ts", "drizzle.config.js")),
    ("tailwind_config", ("tailwind.config.ts", "tailwind.config.js", "tailwind.config.cjs")),
    ("eslint_config", (".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yaml", ".eslintrc")),
    ("prettier_config", (".prettierrc", ".prettierrc.json", ".prettierrc.js", "prettier.config.js")),
    ("postcss_config", ("postcss.config.js", "postcss.config.cjs", "postcss.config.mjs")),
    ("vitest_config", ("vitest.config.ts", "vitest.config.js")),
    ("vitest_server_config", ("vitest.server.config.ts", "vitest.server.config.js")),
    ("jest_config", ("jest.config.ts", "jest.config.js")),
    ("playwright_config", ("playwright.config.ts", "playwright.config.js")),
    ("docker_compose", ("docker-compose.yml", "docker-compose.yaml", "docker-compose/docker-compose.yml")),
    ("dockerfile", ("Dockerfile", "Dockerfile.database")),
    ("vercel_config", ("vercel.json",)),
    ("netlify_config", ("netlify.toml",)),
    ("gitlab_ci", (".gitlab-ci.yml", ".gitlab-ci.yaml")),
    ("i18n_config", (".i18nrc.js", ".i18nrc.ts", ".i18nrc.cjs", "i18n.config.ts", "i18n.config.js")),
    ("sentry_client_config", ("sentry.client.config.ts", "sentry.client.config.js")),
    ("sentry_server_config", ("sentry.server.config.ts", "sentry.server.config.js")),
    ("sentry_edge_config", ("sentry.edge.config.ts", "sentry.edge.config.js")),
    ("commitlint_config", (".commitlintrc.js", ".commitlintrc.cjs", ".commitlintrc.json")),
    ("release_config", (".releaserc.js", ".releaserc.json", ".releaserc.cjs")),
    ("changelog_config", (".changelogrc.js", ".changelogrc.json")),
    ("codecov_config", ("codecov.yml", "codecov.yaml")),
    ("bun_config", (".bunfig.toml",)),
)
DEPLOY_DIRS = (("github_workflows", ".github/workflows"), ("docker_compose_dir", "docker-compose"), ("devcontainer", ".devcontainer"), ("gitlab_ci_dir", ".gitlab"), ("kiro_config", ".kiro"))
HIDDEN_DIRS = ("node_modules", ".git", ".next", ".turbo", ".vercel", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "out", ".cache", ".yarn")
ENV_COUNTED, ENV_LINE = (".env.example", ".env.local.example", ".env.sample"), r"(?m)^(?!#)([A-Z][A-Z0-9_]*)\s*="

#: Where components live and how they are exported (fixed values).
COMPONENT_DIRS = ("components", "features", "icons", "layout", "app")
COMPONENT_FUNCTION = r"export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Z][A-Za-z0-9_]*)\s*[(<]"
COMPONENT_CONST = r"export\s+const\s+([A-Z][A-Za-z0-9_]*)\s*(?::[^=\n]+)?\s*=\s*(?:\(|(?:React\.)?(?:memo|forwardRef|lazy)\s*\()"
COMPONENT_DEFAULT = r"(?md)export\s+default\s+([A-Z][A-Za-z0-9_]*)\s*(?:;|$)"
PROP_NAME = r"(?md)^\s*(?:readonly\s+)?([a-zA-Z_$][\w$]*)\s*\??:"

#: Store modules: folders, middleware, files that are no slices, files that mark a slice (fixed values).
STORE_DIRS = ("src/store", "store")
STORE_MIDDLEWARE = r"\b(devtools|subscribeWithSelector|persist|immer|combine)\b"
STORE_FILES, SLICE_MARKERS = ("initialState", "action", "selectors", "index", "helpers", "types"), ("action", "initialState", "selectors")

#: Routers: folders, tiers, factory calls, procedures and names that are none (fixed values).
ROUTER_DIRS = ("src/server/routers", "src/app/_trpc", "src/trpc", "server/routers", "src/server/api/routers")
ROUTER_TIERS = ("lambda", "async", "edge", "tools")
ROUTER_FACTORY = r"\b(?:createTRPCRouter|router)\s*\("
PROCEDURE = r"([a-zA-Z_$][\w$]*)\s*:\s*\w+(?:\.\w+)*\.\s*(?:query|mutation)\s*\("
NO_PROCEDURES = ("query", "mutation", "input", "output", "use", "middleware")

#: Server modules: folders, exports, and the lines of a file that are looked at (fixed values).
MODULE_DIRS, MODULE_LINES = ("src/server/modules", "server/modules"), 80
MODULE_EXPORT = r"export\s+(?:default\s+)?(?:abstract\s+)?(?:class|function|const|async\s+function)\s+([A-Za-z_$][\w$]*)"

#: Model providers: folders, what shows a capability, and the files and lines that are looked at (fixed values).
#: Capabilities stand in order of their names, in which they are reported.
RUNTIME_DIRS, RUNTIME_FILES, RUNTIME_LINES = ("src/libs/agent-runtime", "src/lib/agent-runtime", "libs/agent-runtime"), 8, 120
CAPABILITIES = (
    ("embedding", r"(?i)\bembedding\b|\bEmbed\b"),
    ("image_generation", r"(?i)\bimage.*generat\b|\bDALL.E\b|\bstable.diffusion\b"),
    ("streaming", r"(?i)\bstream\b|\bStreamingTextResponse\b|\bReadableStream\b"),
    ("tool_call", r"(?i)\btool_call\b|\btoolCall\b|\bfunction_call\b|\btools\b"),
    ("vision", r"(?i)\bvision\b|\bimage_url\b|\bimageUrl\b"),
)
SSO_DIRS = ("src/libs/next-auth/sso-providers", "src/lib/next-auth/sso-providers", "src/libs/auth/sso-providers")

#: Translations: configuration files, locales in them, namespace and locale folders (fixed values).
I18N_CONFIGS = (".i18nrc.js", ".i18nrc.ts", ".i18nrc.cjs", "i18n.config.js", "i18n.config.ts", "src/i18n.ts", "src/i18n/config.ts")
SOURCE_LOCALE = r"""['"]?sourceLocale['"]?\s*[=:]\s*['"]([^'"]+)['"]"""
TARGET_LOCALES = r"""['"]?(?:targetLocales?|outputLocales?)['"]?\s*[=:]\s*\[([^\]]+)\]"""
NAMESPACE_DIRS = ("src/locales/default", "src/i18n/locales", "src/locales", "messages", "locales/default")
LOCALE_DIRS, LOCALE = ("locales", "src/locales", "public/locales"), r"^[a-z]{2}(-[A-Z]{2})?$"
QUOTED = r"""['"]([^'"]+)['"]"""

#: Sign-in: configuration and middleware files, providers, session strategies, matchers (fixed values).
AUTH_CONFIGS = ("src/config/auth.ts", "src/lib/auth.ts", "src/lib/auth/index.ts", "auth.ts", "src/auth.ts", "pages/api/auth/[...nextauth].ts", "src/app/api/auth/[...nextauth]/route.ts")
MIDDLEWARE_FILES = ("middleware.ts", "src/middleware.ts", "middleware.js", "src/middleware.js")
AUTH_PROVIDERS = (
    ("clerk", r"\bClerkProvider\b|\bclerkMiddleware\b|@clerk/"),
    ("next-auth", r"\bNextAuth\b|\bAuthOptions\b|next[-_]auth"),
    ("auth0", r"(?i)\bauth0\b|Auth0Provider"),
    ("github", r"\bGitHubProvider\b"),
    ("azure-ad", r"(?i)\bAzureADProvider\b|\bAzureB2CProvider\b|azure[_-]ad"),
    ("google", r"\bGoogleProvider\b"),
    ("credentials", r"\bCredentialsProvider\b"),
    ("authentik", r"(?i)\bauthentik\b"),
    ("zitadel", r"(?i)\bzitadel\b"),
    ("facebook", r"\bFacebookProvider\b"),
    ("discord", r"\bDiscordProvider\b"),
)
SESSIONS = (("jwt", r"""strategy\s*:\s*['"]jwt['"]"""), ("database", r"""strategy\s*:\s*['"]database['"]"""))
MATCHER = r"""\bmatcher\s*[=:]\s*(\[[\s\S]*?\]|['"][^'"]+['"])"""

#: Packages by kind; a name that ends in a slash is a prefix (fixed values).
PACKAGE_FRAMEWORKS = ("next", "nuxt", "gatsby", "remix", "astro", "svelte", "@angular/core", "react", "vue")
PACKAGE_KINDS = {
    "ui": ("tailwindcss", "@mui/material", "antd", "@chakra-ui/react", "@mantine/core", "@radix-ui/", "framer-motion", "styled-components", "@emotion/react", "shadcn-ui"),
    "database": ("@prisma/client", "prisma", "drizzle-orm", "mongoose", "typeorm", "sequelize", "pg", "mysql2", "better-sqlite3", "@planetscale/database", "@vercel/postgres"),
    "auth": ("next-auth", "@auth/core", "@clerk/nextjs", "lucia", "@supabase/auth-helpers-nextjs", "firebase-admin", "passport"),
    "state": ("zustand", "redux", "@reduxjs/toolkit", "jotai", "recoil", "mobx", "valtio", "@tanstack/react-query", "swr", "xstate"),
    "analytics": ("@sentry/nextjs", "posthog-js", "@vercel/analytics", "@vercel/speed-insights", "mixpanel-browser", "@amplitude/analytics-browser"),
    "ai_sdk": ("ai", "langchain", "@langchain/community", "@langchain/core", "langfuse", "langfuse-core", "@anthropic-ai/sdk", "@google/generative-ai", "@mistralai/mistralai", "gpt-tokenizer", "partial-json"),
    "sync": ("yjs", "y-protocols", "y-webrtc", "y-indexeddb", "y-websocket"),
    "file_parsing": ("pdf-parse", "pdfjs-dist", "mammoth", "officeparser", "sharp", "unstructured-client"),
    "monitoring": ("@sentry/nextjs", "posthog-js", "posthog-node", "@vercel/analytics", "@vercel/speed-insights", "pino", "langfuse", "langfuse-core"),
    "payment": ("stripe", "svix", "@paddle/paddle-node-sdk"),
    "realtime": ("ioredis", "@vercel/edge-config", "@vercel/kv", "@upstash/redis", "pusher", "pusher-js", "socket.io"),
}
PROVIDER_DIRS, FLAG_PATHS = ("src/config/modelProviders", "config/modelProviders"), ("src/config/featureFlags", "src/feature-flags", "src/flags")
BRANDING_FILES, BRANDING_CONST = ("src/config/branding.ts", "src/const/branding.ts", "src/branding.ts"), r"export\s+(?:const|let)\s+([A-Z_][A-Z0-9_]*)\s*="

#: Databases: schema files, models and their fields, folders (fixed values).
PRISMA_SCHEMA, PRISMA_MODEL, PRISMA_FIELD = "prisma/schema.prisma", r"(?m)^model\s+(\w+)\s*\{", r"(?m)^\s+(\w+)\s+\w+"
DRIZZLE_CONFIGS = ("drizzle.config.ts", "drizzle.config.js", "drizzle.config.mjs")
DRIZZLE_DIRS = ("db", "drizzle", "database", "src/db", "src/drizzle", "src/database", "src/database/schemas")
DRIZZLE_TABLE = r"""(?:pgTable|mysqlTable|sqliteTable)\s*\(\s*['"]([^'"]+)['"]"""
DRIZZLE_FIELD, DRIZZLE_RELATION = r"(?m)^\s*([a-zA-Z_$][\w$]*)\s*:", r"\brelations\s*\(\s*(\w+)\s*,"
MIGRATION_DIRS = ("drizzle/migrations", "src/database/migrations", "src/db/migrations", "migrations")
DB_MODEL_DIRS = ("src/database/server/models", "src/db/models", "src/models")
REPOSITORY_DIRS = ("src/database/repositories", "src/db/repositories", "src/repositories")
CLIENT_DIRS = ("src/database/client", "src/db/client")
ENTITY_DIRS = ("src/entities", "src/entity", "entities", "entity")
ENTITY_CLASS = r"(?s)@Entity\s*\(.*?\)\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"
ENTITY_COLUMN = r"@(?:Column|PrimaryColumn|PrimaryGeneratedColumn)\b[^)]*\)\s*\n\s*([a-zA-Z_$][\w$]*)\s*[!?]?\s*:"

NAMES = "array<string>"
MODELS = "array<struct<name: string, fields: array<string>>>"


def _text() -> Column:
    return F.coalesce("content", F.lit(""))


def _none(kind: str = NAMES) -> Column:
    return F.array().cast(kind)


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _none())


def _one(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _head(text: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(text, S.LINE_ENDS), 1, lines), "\n")


def _pick(candidates: Sequence[str]) -> Column:
    """An aggregate: (path, content) of the first of these files that exists, else null."""
    rank = F.coalesce(*[F.when(F.col("path") == p, i) for i, p in enumerate(candidates)])
    return F.min_by(F.struct("path", _text().alias("content")), rank)


def _below(folder: str) -> Column:
    """The path below a folder, null for other files."""
    return F.when(F.col("path").startswith(folder + "/"), F.substring("path", len(folder) + 2, 1 << 30))


def _listed(folders: Sequence[str], name, nonempty: bool = False) -> Column:
    """An aggregate: sorted distinct names of what is in the first of these folders that exists (or has a name).
    ``name`` takes the path below the folder, in parts, to a name or null."""
    found = [F.sort_array(F.collect_set(name(F.split(_below(d), "/")))) for d in folders]
    exists = [F.size(x) > 0 if nonempty else F.count(_below(d)) > 0 for d, x in zip(folders, found, strict=True)]
    return F.coalesce(*[F.when(e, x) for e, x in zip(exists, found, strict=True)], _none())


def _file(parts: Column, pattern: str) -> Column:
    """Of a file directly in the folder, the first group of the pattern."""
    return F.when(F.size(parts) == 1, F.nullif(F.regexp_extract(parts[0], pattern, 1), F.lit("")))


def _dependencies(package: Column) -> Column:
    """Names of all packages in the text of a package.json."""
    sections = [F.from_json(F.get_json_object(package, f"$.{s}"), "map<string,string>") for s in ("dependencies", "devDependencies", "peerDependencies")]
    return F.array_distinct(F.concat(*[F.coalesce(F.map_keys(s), _none()) for s in sections]))


def brace_body(text: Column) -> Column:
    """What lies between the brace that the text begins with and its partner; null if it has none.

    A fold over the closing braces counts how many are needed; braces in strings count too."""
    pieces = F.split(text, r"\}", -1)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("closed"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.length(piece) - F.length(F.translate(piece, "{", "")) - 1
        return F.when(s["closed"], s).otherwise(F.struct(depth.alias("depth"), (s["used"] + 1).alias("used"), (depth <= 0).alias("closed")))

    end = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), begin, step, lambda s: F.when(s["closed"], s["used"]))
    return F.when(end.isNotNull(), F.substring(F.array_join(F.slice(pieces, 1, end), "}"), 2, 1 << 30))


def _blocks(text: Column, pattern: str, name) -> Column:
    """``name`` of the text from each match of the pattern on, in order."""
    bare = pattern.replace("(?m)", "")
    parts = F.split(text, f"(?m)(?={bare})")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(F.element_at(parts, i).rlike(f"^{bare.lstrip('^')}"), name(F.array_join(F.slice(parts, i, F.size(parts)), ""))))
    return F.filter(each, lambda x: x.isNotNull())


def structure(files: DataFrame) -> DataFrame:
    """One row: src_structure, config_files, env_files, root_dirs, has_src_prefix, deploy_dirs, env_summary."""
    parts = F.split("path", "/")
    probes = [p for _, paths in CONFIG_FILES for p in paths]
    facts = files.agg(
        F.sort_array(F.collect_set(F.when(F.size(parts) > 1, parts[0]))).alias("top"),
        F.collect_set(F.when((F.size(parts) > 2) & (parts[0] == "src"), F.get(parts, F.lit(1)))).alias("inner"),
        F.collect_set(F.when(F.col("path").isin(*probes), F.col("path"))).alias("configs"),
        F.sort_array(F.collect_set(F.when((F.size(parts) == 1) & parts[0].startswith(".env"), parts[0]))).alias("env_files"),
        *[F.count(_below(d)).alias(k) for k, d in DEPLOY_DIRS],
        _pick(ENV_COUNTED).alias("env"),
    )

    def mapped(entries: list[tuple[str, Column]]) -> Column:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries])
        return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))

    has = F.array_contains
    sources = [(d, F.when(has("inner", d), f"src/{d}/").when(has("top", d), f"{d}/")) for d in SOURCE_DIRS]
    configs = [(k, F.coalesce(*[F.when(has("configs", p), p) for p in paths])) for k, paths in CONFIG_FILES]
    names = _all(F.col("env.content"), ENV_LINE)
    prefixes = F.transform(names, lambda x: F.split(x, "_")[0])
    counts = F.map_from_entries(F.transform(F.array_distinct(prefixes), lambda p: F.struct(p.alias("key"), F.size(F.filter(prefixes, lambda x: x == p)).alias("value"))))
    summary = F.struct(F.col("env.path").alias("file"), F.size(names).alias("total_vars"), counts.alias("categories"))
    return facts.select(
        mapped(sources).alias("src_structure"),
        mapped(configs).alias("config_files"),
        "env_files",
        F.filter("top", lambda x: ~x.isin(*HIDDEN_DIRS)).alias("root_dirs"),
        has("top", "src").alias("has_src_prefix"),
        mapped([(k, F.when(F.col(k) > 0, d)) for k, d in DEPLOY_DIRS]).alias("deploy_dirs"),
        F.when(F.col("env").isNotNull(), summary).alias("env_summary"),
    )


def components(files: DataFrame) -> DataFrame:
    """(name, file, position, props) of each exported component, once a file; props are those of its ``<name>Props``."""
    rows = [below_first(files, (f"src/{d}", d)) for d in COMPONENT_DIRS]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    found = found.where(F.col("path").endswith(".tsx")).select("path", _text().alias("content"))
    text = F.col("content")
    defined = _all(text, r"(?:async\s+)?function\s+([A-Za-z0-9_]+)\b")
    names = F.concat(_all(text, COMPONENT_FUNCTION), _all(text, COMPONENT_CONST), F.array_intersect(_all(text, COMPONENT_DEFAULT), defined))
    each = found.select("path", "content", F.posexplode(F.array_distinct(names)).alias("position", "name"))
    typed = F.concat(F.lit(r"(?s)(?:interface\s+"), "name", F.lit(r"Props\s*(?:<[^>]*>)?\s*\{|type\s+"), "name", F.lit(r"Props\s*(?:<[^>]*>)?\s*=\s*\{).*"))
    begins = F.regexp_extract(F.call_function("regexp_extract", "content", typed, F.lit(0)), r"(?s)\{.*", 0)
    return each.select("name", F.col("path").alias("file"), "position", _all(brace_body(begins), PROP_NAME).alias("props"))


def stores(files: DataFrame) -> DataFrame:
    """(store, path, slices, middleware) of each store module that has source files."""
    parts = F.split("rest", "/")
    rows = below_first(files, STORE_DIRS).select("root", parts.alias("p"), _text().alias("content")).where(F.size("p") > 1)
    depth, second, third = F.size("p"), F.col("p")[1], F.get("p", F.lit(2))
    source = F.element_at("p", -1).rlike(r"\.tsx?$")
    third_stem = F.regexp_extract(third, r"^(.+)\.tsx?$", 1)
    listed = F.when(depth > 3, third).when((third_stem != "") & ~third_stem.isin(*STORE_FILES), third_stem)
    found = rows.groupBy("root", F.col("p")[0].alias("store")).agg(
        F.bool_or(source).alias("any"),
        F.bool_or((second == "slices") & (depth > 2)).alias("explicit"),
        F.collect_set(F.when((second == "slices") & (depth > 2), listed)).alias("listed"),
        F.collect_set(F.when((depth == 3) & third_stem.isin(*SLICE_MARKERS), second)).alias("marked"),
        F.collect_set(F.when(source, F.array_sort(F.array_distinct(_all(F.col("content"), STORE_MIDDLEWARE))))).alias("used"),
    )
    slices = F.sort_array(F.when(F.col("explicit"), F.col("listed")).otherwise(F.col("marked")))
    return found.where("any").select("store", F.concat_ws("/", "root", "store").alias("path"), slices.alias("slices"), F.sort_array(F.array_distinct(F.flatten("used"))).alias("middleware"))


def trpc_routers(files: DataFrame) -> DataFrame:
    """(tier, router, file, procedures) of each file that makes a router, directly in a tier's folder or the root's."""
    parts = F.split("rest", "/")
    tier = F.when(F.size(parts) == 1, "root").when((F.size(parts) == 2) & parts[0].isin(*ROUTER_TIERS), parts[0])
    rows = below_first(files, ROUTER_DIRS).select(tier.alias("tier"), "path", _text().alias("content"))
    rows = rows.where(F.col("tier").isNotNull() & F.col("path").endswith(".ts") & F.col("content").rlike(ROUTER_FACTORY))
    procedures = F.filter(F.array_distinct(_all(F.col("content"), PROCEDURE)), lambda x: ~x.isin(*NO_PROCEDURES))
    return rows.select("tier", S.stem("path").alias("router"), F.col("path").alias("file"), procedures.alias("procedures"))


def server_modules(files: DataFrame) -> DataFrame:
    """(module, path, files, exports) of each folder of server modules; exports are those near the top of its files."""
    parts = F.split("rest", "/")
    rows = below_first(files, MODULE_DIRS).select("root", parts[0].alias("module"), F.size(parts).alias("depth"), F.element_at(parts, -1).alias("name"), _text().alias("content"))
    source = F.col("name").endswith(".ts") & ~F.col("name").startswith("_")
    rows = rows.where((F.col("depth") > 1) & ~F.col("module").rlike(r"^[._]"))
    names = F.when(source, _all(_head(F.col("content"), MODULE_LINES), MODULE_EXPORT)).otherwise(_none())
    found = rows.select("root", "module", F.when(source & (F.col("depth") == 2), F.col("name")).alias("own"), F.explode_outer(names).alias("export"))
    found = found.groupBy("root", "module").agg(F.sort_array(F.collect_set("own")).alias("files"), F.sort_array(F.collect_set("export")).alias("exports"))
    return found.select("module", F.concat_ws("/", "root", "module").alias("path"), "files", "exports")


def llm_providers(files: DataFrame) -> DataFrame:
    """(provider, path, capabilities) of each model provider, by the top of its first source files."""
    parts = F.split("rest", "/")
    rows = below_first(files, RUNTIME_DIRS).select("root", parts[0].alias("provider"), parts.alias("p"), F.col("path").endswith(".ts").alias("source"), _text().alias("content"))
    rows = rows.where((F.size("p") > 1) & ~F.col("provider").rlike(r"^[._]"))
    order = Window.partitionBy("root", "provider").orderBy(F.desc("source"), "p")
    head = F.when(F.col("source") & (F.row_number().over(order) <= RUNTIME_FILES), _head(F.col("content"), RUNTIME_LINES))
    found = rows.select("root", "provider", head.alias("head")).groupBy("root", "provider").agg(*[F.bool_or(F.col("head").rlike(p)).alias(c) for c, p in CAPABILITIES])
    able = F.filter(F.array(*[F.when(F.col(c), c) for c, _ in CAPABILITIES]), lambda x: x.isNotNull())
    return found.select("provider", F.concat_ws("/", "root", "provider").alias("path"), able.alias("capabilities"))


def sso_providers(files: DataFrame) -> DataFrame:
    """(provider) of each file of single sign-on."""
    name = F.regexp_extract("rest", r"^(?!_|index)([^/]+)\.ts$", 1)
    return below_first(files, SSO_DIRS).select(name.alias("provider")).where("provider != ''")


def i18n(files: DataFrame) -> DataFrame:
    """One row: source_lang, target_langs, namespaces, namespace_count, generated_langs, config_file."""
    locale = lambda p: F.when((F.size(p) > 1) & p[0].rlike(LOCALE), p[0])
    facts = files.agg(_pick(I18N_CONFIGS).alias("config"), _listed(NAMESPACE_DIRS, lambda p: _file(p, r"^((?!_).+)\.(?:ts|json)$"), True).alias("namespaces"), _listed(LOCALE_DIRS, locale, True).alias("generated_langs"))
    text = F.col("config.content")
    facts = facts.withColumn("source_lang", _one(text, SOURCE_LOCALE))
    targets = F.filter(F.array_distinct(_all(F.regexp_extract(text, TARGET_LOCALES, 1), QUOTED)), lambda x: ~x.eqNullSafe(F.col("source_lang")))
    return facts.select("source_lang", targets.alias("target_langs"), "namespaces", F.size("namespaces").alias("namespace_count"), "generated_langs", F.col("config.path").alias("config_file"))


def auth(files: DataFrame) -> DataFrame:
    """One row: providers, session_strategy, middleware_file, middleware_matchers, auth_routes, config_file, sso_providers.

    auth_routes are the folders directly in the ``(auth)`` groups of the app folder, by group."""

    def grouped(folder: str) -> Column:
        p = F.split(_below(folder), "/")
        at = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (F.element_at(p, i) == "(auth)") & (i + 1 < F.size(p)))
        return F.collect_set(F.when(F.size(at) > 0, F.transform(at, lambda i: F.struct(F.slice(p, 1, i).alias("group"), F.element_at(p, i + 1).alias("sub")))))

    facts = files.agg(
        _pick(AUTH_CONFIGS).alias("config"),
        _pick(MIDDLEWARE_FILES).alias("middleware"),
        (F.count(_below("src/app")) > 0).alias("inner"),
        grouped("src/app").alias("inner_groups"),
        grouped("app").alias("outer_groups"),
        _listed(SSO_DIRS, lambda p: _file(p, r"^((?!_|index).+)\.ts$")).alias("sso_providers"),
    )
    text, guard = F.col("config.content"), F.col("middleware.content")
    shown = F.array(*[F.when(F.coalesce(text.rlike(p), F.lit(False)) | F.coalesce(guard.rlike(p), F.lit(False)), n) for n, p in AUTH_PROVIDERS])
    groups = F.sort_array(F.array_distinct(F.flatten(F.when(F.col("inner"), F.col("inner_groups")).otherwise(F.col("outer_groups")))))
    subs = F.transform(F.filter(groups, lambda g: ~g["sub"].rlike(r"^[@(]")), lambda g: g["sub"])
    return facts.select(
        F.sort_array(F.filter(shown, lambda x: x.isNotNull())).alias("providers"),
        F.coalesce(*[F.when(text.rlike(p), s) for s, p in SESSIONS]).alias("session_strategy"),
        F.col("middleware.path").alias("middleware_file"),
        _all(F.regexp_extract(guard, MATCHER, 1), QUOTED).alias("middleware_matchers"),
        subs.alias("auth_routes"),
        F.col("config.path").alias("config_file"),
        "sso_providers",
    )


def packages(files: DataFrame) -> DataFrame:
    """One row: framework, the known packages of each kind, ai_providers, branding (file, constants), feature_flags."""
    name = lambda p: F.when(~p[0].startswith("_"), F.when(F.size(p) > 1, p[0]).otherwise(S.stem(p[0])))
    flags = [F.coalesce(F.bool_or((F.col("path") == p) | F.col("path").startswith(p + "/")), F.lit(False)) for p in FLAG_PATHS]
    facts = files.agg(_pick(("package.json",)).alias("package"), _listed(PROVIDER_DIRS, name).alias("ai_providers"), _pick(BRANDING_FILES).alias("brand"), (flags[0] | flags[1] | flags[2]).alias("feature_flags"))
    facts = facts.withColumn("deps", _dependencies(F.col("package.content")))

    def known(entry: str) -> Column:
        hit = F.exists("deps", lambda x: x.startswith(entry)) if entry.endswith("/") else F.array_contains("deps", entry)
        return F.when(hit, entry.rstrip("/"))

    kinds = [F.sort_array(F.filter(F.array(*map(known, entries)), lambda x: x.isNotNull())).alias(k) for k, entries in PACKAGE_KINDS.items()]
    constants = F.array_sort(F.array_distinct(_all(F.col("brand.content"), BRANDING_CONST)))
    branding = F.when(F.col("brand").isNotNull(), F.struct(F.col("brand.path").alias("file"), constants.alias("constants")))
    return facts.select(F.coalesce(*map(known, PACKAGE_FRAMEWORKS)).alias("framework"), *kinds, "ai_providers", branding.alias("branding"), "feature_flags")


def _ranked(files: DataFrame, folders: Sequence[str], source: str) -> DataFrame:
    """Source files below any of the folders, with ``at``, their place in the order of folders, endings and paths."""
    rank = F.coalesce(*[F.when(F.col("path").startswith(d + "/"), i) for i, d in enumerate(folders)])
    at = F.struct(rank.alias("rank"), F.col("path").endswith(".tsx").alias("x"), F.split("path", "/").alias("p"))
    return files.where(F.col("path").rlike(source)).select(at.alias("at"), _text().alias("content")).where("at.rank is not null")


def database(files: DataFrame) -> DataFrame:
    """A row for each mapper that package.json names and whose files are there: (orm, schema, models, relations,
    migration_dir, db_models, repositories, client_files, migration_count); the last six of Drizzle only.
    Fields of an entity class are those of its whole file; a table name counts where it is first seen."""
    package = _pick(("package.json",))
    blank = {"relations": NAMES, "migration_dir": "string", "db_models": "array<struct<name: string, file: string>>", "repositories": NAMES, "client_files": NAMES, "migration_count": "int"}

    def rows(df: DataFrame, orm: str, names: tuple[str, ...], schema: Column, extra: dict[str, Column]) -> DataFrame:
        df = df.where(F.arrays_overlap(_dependencies(F.col("package.content")), F.array(*map(F.lit, names))))
        more = [extra.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in blank.items()]
        return df.select(F.lit(orm).alias("orm"), schema.cast("string").alias("schema"), F.col("models").cast(MODELS).alias("models"), *more)

    def prisma_model(rest: Column) -> Column:
        body = brace_body(F.regexp_extract(rest, r"(?s)\{.*", 0))
        return F.when(body.isNotNull(), F.struct(F.regexp_extract(rest, PRISMA_MODEL, 1).alias("name"), _all(body, PRISMA_FIELD).alias("fields")))

    facts = files.agg(package.alias("package"), _pick((PRISMA_SCHEMA,)).alias("schema")).where("schema is not null")
    prisma = rows(facts.withColumn("models", _blocks(F.col("schema.content"), PRISMA_MODEL, prisma_model)), "Prisma", ("prisma", "@prisma/client"), F.lit(PRISMA_SCHEMA), {})

    def drizzle_table(rest: Column) -> Column:
        body = brace_body(F.regexp_extract(rest, rf"(?s)^{DRIZZLE_TABLE}[^{{]*(\{{.*)", 2))
        return F.struct(F.regexp_extract(rest, DRIZZLE_TABLE, 1).alias("name"), _all(body, DRIZZLE_FIELD).alias("fields"))

    sources = _ranked(files, DRIZZLE_DIRS, r"\.tsx?$")
    tables = sources.select("at", F.posexplode(_blocks(F.col("content"), DRIZZLE_TABLE, drizzle_table)).alias("i", "t"))
    tables = tables.groupBy("t.name").agg(F.min(F.struct("at", "i", "t.fields")).alias("first"))
    models = tables.agg(F.sort_array(F.collect_list(F.struct("first.at", "first.i", "name", "first.fields"))).alias("found"))
    models = models.select(F.transform("found", lambda x: F.struct(x["name"].alias("name"), x["fields"].alias("fields"))).alias("models"))
    related = sources.select(F.explode(_all(F.col("content"), DRIZZLE_RELATION)).alias("name")).agg(F.sort_array(F.collect_set("name")).alias("relations"))
    model_file = lambda d: F.struct((F.size(F.split(_below(d), "/")) - 1).alias("depth"), F.split(_below(d), "/").alias("p"), S.stem("path").alias("name"), F.col("path").alias("file"))
    in_models = lambda d: _below(d).rlike(r"^(?:[^_./][^/]*/)?(?!_|index)[^/]+\.ts$")
    listed = [(F.count(_below(d)) > 0, F.sort_array(F.collect_set(F.when(in_models(d), model_file(d))))) for d in DB_MODEL_DIRS]
    facts = files.agg(
        package.alias("package"),
        _pick(DRIZZLE_CONFIGS).alias("config"),
        F.count(F.when(F.col("path").rlike(rf"^(?:{'|'.join(DRIZZLE_DIRS)})/.*\.tsx?$"), 1)).alias("sources"),
        F.coalesce(*[F.when(F.count(_below(d)) > 0, d) for d in MIGRATION_DIRS]).alias("migration_dir"),
        F.coalesce(*[F.when(F.count(_below(d)) > 0, F.count(F.when(_below(d).rlike(r"^[^/]*\.sql$"), 1))) for d in MIGRATION_DIRS], F.lit(0)).alias("migration_count"),
        F.coalesce(*[F.when(e, x) for e, x in listed]).alias("listed"),
        _listed(REPOSITORY_DIRS, lambda p: F.when((F.size(p) > 1) & ~p[0].rlike(r"^[._]"), p[0])).alias("repositories"),
        F.coalesce(*[F.when(F.count(_below(d)) > 0, F.sort_array(F.collect_set(F.when(_below(d).rlike(r"^[^_/][^/]*\.ts$"), F.col("path"))))) for d in CLIENT_DIRS], _none()).alias("client_files"),
    )
    facts = facts.where("sources > 0 or config is not null").withColumn("one", F.lit(1))
    for part in (models, related):  # one row each
        facts = facts.join(F.broadcast(part.withColumn("same", F.lit(1))), F.col("one") == F.col("same")).drop("same")
    entries = F.coalesce(F.transform("listed", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"))), _none(blank["db_models"]))
    drizzle = rows(facts, "Drizzle", ("drizzle-orm",), F.col("config.path"), {"db_models": entries} | {k: F.col(k) for k in blank if k != "db_models"})

    columns = _all(F.col("content"), ENTITY_COLUMN).alias("fields")
    entities = _ranked(files, ENTITY_DIRS, r"\.ts$").select("at", columns, F.posexplode(_all(F.col("content"), ENTITY_CLASS)).alias("i", "name"))
    entities = entities.agg(F.sort_array(F.collect_list(F.struct("at", "i", "name", "fields"))).alias("found")).where("size(found) > 0")
    entities = entities.select(F.transform("found", lambda x: F.struct(x["name"].alias("name"), x["fields"].alias("fields"))).alias("models"), F.lit(1).alias("same"))
    facts = files.agg(package.alias("package")).withColumn("one", F.lit(1)).join(F.broadcast(entities), F.col("one") == F.col("same"))
    typeorm = rows(facts, "TypeORM", ("typeorm",), F.lit(None), {})
    return prisma.unionByName(drizzle).unionByName(typeorm)
