import pytest
from pyspark.sql import functions as F

from tessera.operators import app_detectors, scanner

CARD = """export interface CardProps<T> {
  readonly id: string;
  style?: { color: string };
}
export default function Card<T>(p) {}
export const Memo: FC = React.memo(() => 1);
export const plain = 3;
function Tail() {}
export default Tail;
"""
DRIZZLE = """export const users = pgTable('users', {
  id: serial('id'),
  meta: json({ a: 1 }),
}, (t) => ({ ix: index() }));
export const bare = pgTable("bare", make());
export const again = pgTable('users', { x: int() });
export const r = relations(users, () => ({}));
"""
ENTITY = "@Entity({ name: 'a' })\nexport class Alpha {\n  @Column({ n: 1 })\n  one!: string;\n}\n@Entity()\nclass Beta {\n  @PrimaryColumn()\n  two: number;\n}\n"
PRISMA = "model User {\n  id Int @id\n  posts Post[]\n  @@map(\"u\")\n}\n\nmodel Broken {\n  id Int\n"
PACKAGE = '{"dependencies": {"react": "1", "@radix-ui/react-x": "1", "prisma": "1", "drizzle-orm": "1"}, "devDependencies": {"typeorm": "1", "zustand": "1"}, "peerDependencies": {"langfuse": "1"}}'


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("package.json", PACKAGE),
        ("tsconfig.base.json", "{}"),
        ("docker-compose/docker-compose.yml", ""),
        (".github/workflows/ci.yml", ""),
        (".env", ""),
        (".env.sample", "# A=1\nAUTH_ID = 1\nAUTH_KEY=2\nPORT=3\nno=1\n"),
        ("node_modules/x/y.ts", ""),
        ("hooks/useA.ts", None),
        ("src/components/Card.tsx", CARD),
        ("components/Never.tsx", "export function Never() {}"),
        ("src/app/(auth)/login/page.tsx", None),
        ("src/app/(auth)/@modal/x/page.tsx", ""),
        ("src/app/(auth)/note.txt", ""),
        ("src/app/a/(auth)/signup/page.tsx", ""),
        ("src/app/(auth)/reset/page.tsx", ""),
        ("src/store/user/slices/auth/action.ts", "persist(devtools(x))"),
        ("src/store/user/slices/credits.ts", "immer; devtools"),
        ("src/store/user/slices/index.ts", ""),
        ("src/store/chat/topic/selectors.ts", ""),
        ("src/store/chat/helpers/x.ts", ""),
        ("src/store/docs/readme.md", ""),
        ("src/server/routers/lambda/agent.test.ts", "router({ get: p.input(z).query(f), list: p.query(f), use: t.q.mutation(g), list: p.query(f), list: x.y.mutation(h) })"),
        ("src/server/routers/index.ts", "createTRPCRouter ({})"),
        ("src/server/routers/async/no.ts", "nothing"),
        ("src/server/routers/other/agent.ts", "router({})"),
        ("src/server/modules/Agent/index.ts", "export class Agent {}\nexport async function run() {}\n" + "\n" * 90 + "export const late = 1"),
        ("src/server/modules/Agent/_own.ts", "export const own = 1"),
        ("src/server/modules/Agent/sub/a.ts", "export default abstract class Sub {}"),
        ("src/server/modules/Empty/readme.md", ""),
        ("src/server/modules/_x/a.ts", ""),
        ("src/libs/agent-runtime/openai/index.ts", "new ReadableStream(); image_url; TOOLS"),
        ("src/libs/agent-runtime/openai/" + "z/a.ts", "\n" * 130 + "embedding"),
        ("src/libs/agent-runtime/local/readme.md", "vision"),
        ("src/libs/agent-runtime/index.ts", ""),
        *[(f"src/libs/agent-runtime/many/f{i}.ts", "embed" if i == 8 else "vision" if i == 7 else "") for i in range(9)],
        ("src/libs/next-auth/sso-providers/github.ts", ""),
        ("src/libs/next-auth/sso-providers/index.ts", ""),
        (".i18nrc.js", "module.exports = { sourceLocale: 'zh-CN', outputLocales: ['en-US',\n 'zh-CN', \"fr\", 'fr'] }"),
        ("src/locales/default/readme.md", ""),
        ("src/locales/common.ts", ""),
        ("src/locales/_own.ts", ""),
        ("locales/en-US/a.json", ""),
        ("locales/english/a.json", ""),
        ("src/auth.ts", "NextAuth({ providers: [GitHubProvider()], session: { strategy: \"database\" } })"),
        ("src/middleware.ts", "// ZITADEL\nexport const config = { matcher: ['/a', \"/b/(.*)\"] }"),
        ("config/modelProviders/openai.ts", ""),
        ("config/modelProviders/azure/x.ts", ""),
        ("config/modelProviders/_x.ts", ""),
        ("src/const/branding.ts", "export const ORG = 1\nexport let APP_NAME = 2\nexport const lower = 3\nexport const ORG = 4"),
        ("src/flags/a.ts", ""),
        ("prisma/schema.prisma", PRISMA),
        ("src/db/schema.ts", DRIZZLE),
        ("src/db/migrations/0001.sql", ""),
        ("src/db/migrations/meta/x.sql", ""),
        ("src/db/models/user.ts", ""),
        ("src/db/models/index.ts", ""),
        ("src/db/models/eval/run.ts", ""),
        ("src/db/client/pg.ts", ""),
        ("src/db/repositories/import/a.ts", ""),
        ("src/entities/a.ts", ENTITY),
    ]
    return spark.createDataFrame(rows, "path string, content string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_structure(files):
    r = app_detectors.structure(files).first()
    assert r.src_structure["components"] == "src/components/" and r.src_structure["hooks"] == "hooks/" and "public" not in r.src_structure
    assert r.config_files == {"package_json": "package.json", "tsconfig": "tsconfig.base.json", "docker_compose": "docker-compose/docker-compose.yml", "i18n_config": ".i18nrc.js"}
    assert r.env_files == [".env", ".env.sample"] and r.has_src_prefix
    assert r.root_dirs == [".github", "components", "config", "docker-compose", "hooks", "locales", "prisma", "src"]
    assert r.deploy_dirs == {"github_workflows": ".github/workflows", "docker_compose_dir": "docker-compose"}
    assert r.env_summary.asDict() == {"file": ".env.sample", "total_vars": 3, "categories": {"AUTH": 2, "PORT": 1}}


def test_components(files):
    assert got(app_detectors.components(files)) == [("Card", "src/components/Card.tsx", 0, ["id", "style"]), ("Memo", "src/components/Card.tsx", 1, []), ("Tail", "src/components/Card.tsx", 2, [])]


def test_stores(files):
    assert got(app_detectors.stores(files)) == [("chat", "src/store/chat", ["topic"], []), ("user", "src/store/user", ["auth", "credits"], ["devtools", "immer", "persist"])]


def test_trpc_routers(files):
    # "get" is followed by a call, "use" is reserved
    assert got(app_detectors.trpc_routers(files)) == [("lambda", "agent.test", "src/server/routers/lambda/agent.test.ts", ["list"]), ("root", "index", "src/server/routers/index.ts", [])]


def test_server_modules(files):
    assert got(app_detectors.server_modules(files)) == [("Agent", "src/server/modules/Agent", ["index.ts"], ["Agent", "Sub", "run"]), ("Empty", "src/server/modules/Empty", [], [])]


def test_providers(files):
    root = "src/libs/agent-runtime"
    assert got(app_detectors.llm_providers(files)) == [("local", f"{root}/local", []), ("many", f"{root}/many", ["vision"]), ("openai", f"{root}/openai", ["streaming", "tool_call", "vision"])]
    assert got(app_detectors.sso_providers(files)) == [("github",)]


def test_i18n(files):
    assert got(app_detectors.i18n(files)) == [("zh-CN", ["en-US", "fr"], ["common"], 1, ["en-US"], ".i18nrc.js")]


def test_auth(files):
    assert got(app_detectors.auth(files)) == [(["github", "next-auth", "zitadel"], "database", "src/middleware.ts", ["/a", "/b/(.*)"], ["login", "reset", "signup"], "src/auth.ts", ["github"])]


def test_packages(files):
    r = app_detectors.packages(files).first().asDict(recursive=True)
    want = {"framework": "react", "ui": ["@radix-ui"], "database": ["drizzle-orm", "prisma", "typeorm"], "state": ["zustand"], "ai_sdk": ["langfuse"], "monitoring": ["langfuse"], "payment": [], "ai_providers": ["azure", "openai"], "branding": {"file": "src/const/branding.ts", "constants": ["APP_NAME", "ORG"]}, "feature_flags": True}
    assert {k: r[k] for k in want} == want


def test_database(files):
    rows = {r.orm: r.asDict(recursive=True) for r in app_detectors.database(files).collect()}
    assert rows["Prisma"]["schema"] == "prisma/schema.prisma"
    assert rows["Prisma"]["models"] == [{"name": "User", "fields": ["id", "posts"]}]
    d = rows["Drizzle"]
    assert d["models"] == [{"name": "users", "fields": ["id", "meta"]}, {"name": "bare", "fields": ["x"]}]
    assert (d["schema"], d["relations"], d["migration_dir"], d["migration_count"]) == (None, ["users"], "src/db/migrations", 1)
    assert d["db_models"] == [{"name": "user", "file": "src/db/models/user.ts"}, {"name": "run", "file": "src/db/models/eval/run.ts"}]
    assert (d["repositories"], d["client_files"]) == (["import"], ["src/db/client/pg.ts"])
    assert rows["TypeORM"]["models"] == [{"name": "Alpha", "fields": ["one", "two"]}, {"name": "Beta", "fields": ["one", "two"]}]


def test_gated(files):
    assert got(app_detectors.database(files.where("path != 'package.json'"))) == []


def test_summary(files, spark):
    r = scanner.summarize(scanner.scan_repository(files)).first().asDict()
    want = {"framework": "React", "components_count": 3, "stores_count": 2, "trpc_routers_count": 2, "trpc_procedures_count": 1, "database": "Prisma", "db_models_count": 0, "i18n_source_lang": "zh-CN", "i18n_namespace_count": 1, "auth_providers": ["github", "next-auth", "zitadel"], "server_modules_count": 2, "ai_providers_count": 3, "sso_providers_count": 1, "env_vars_total": 3, "libs_count": 2}
    assert {k: r[k] for k in want} == want
    empty = scanner.summarize({"libs": spark.createDataFrame([], "lib string")}).first()
    assert (empty.framework, empty.routes_count, empty.database, empty.auth_providers) == ("unknown", 0, None, [])


def test_brace_body(spark):
    rows = [("{a{b}c}d}",), ("{}",), ("{a{b}",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(app_detectors.brace_body(F.col("t")))
    assert [r[0] for r in df.collect()] == ["a{b}c", "", None, None, None]
