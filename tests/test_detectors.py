import pytest

from tessera.operators import scanner


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("package.json", '{"dependencies": {"next": "^15.1.0-rc.2", "react": "19.0.0"}, "devDependencies": {"vue": "3.1"}}'),
        ("tsconfig.json", "{}"),
        ("yarn.lock", ""),
        ("bun.lockb", None),
        ("src/app/layout.tsx", ""),
        ("src/app/(main)/users/[id]/page.tsx", ""),
        ("src/app/@modal/(.)photo/page.tsx", ""),
        ("src/app/(backend)/api/users/route.ts", "export async function POST(r) {}\nexport const GET = h;"),
        ("app/other/page.tsx", ""),
        (".env.sample", "OTHER_NAME=1"),
        (".env.example", "# note\nOPENAI_API_KEY=x\n  NEXT_PUBLIC_CLERK_KEY = y\nNEXT_PUBLIC_URL\nPORT=1\nlower=2"),
        ("scripts/build.tool.ts", ""),
        ("scripts/db/b.ts", ""),
        ("scripts/db/a.ts", ""),
        ("scripts/db/deep/c.ts", ""),
        ("scripts/.hidden", ""),
        ("src/libs/trpc/server.ts", ""),
        ("src/libs/trpc/client.tsx", ""),
        ("src/libs/trpc/_own.ts", ""),
        ("src/libs/empty/sub/x.ts", ""),
        ("lib/never/x.ts", ""),
        ("src/services/auth.service.ts", "export const token: string = 1;\nexport async function logIn(a) {}\nexport function token(b) {}"),
        ("services/never.ts", ""),
        ("utils/x.tsx", "export abstract class Tool {}"),
        ("utils/bad.ts", None),
        ("hooks/useA.tsx", "export const useB = (x) => x"),
        ("hooks/useZ.ts", "export default function useZ(a: string, ...rest, { c }) {}\nexport const useB = (y = 2, z) => y"),
        ("hooks/_own.ts", "export const useOwn = () => 1"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    return {k: [tuple(r) for r in df.collect()] for k, df in scanner.scan_repository(files).items()}


def test_framework(found):
    assert found["framework"] == [("Next.js", "TypeScript", True, "15.1.0-rc.2", "yarn")]


def test_routes(found):
    got = {r[2]: (r[0], r[1], r[3], r[4], r[5]) for r in found["routes"]}
    assert got == {
        "src/app/(main)/users/[id]/page.tsx": ("/users/[id]", "page", None, None, None),
        "src/app/@modal/(.)photo/page.tsx": ("/photo", "intercepted", "@modal", None, None),
        "src/app/(backend)/api/users/route.ts": ("/api/users", "api", None, ["GET", "POST"], "api"),
    }


def test_env_vars(found):
    got = [(r[0], r[2], r[3]) for r in sorted(found["env_vars"], key=lambda r: r[1])]
    assert got == [(".env.example", n, c) for n, c in (("OPENAI_API_KEY", "LLM"), ("NEXT_PUBLIC_CLERK_KEY", "AUTH"), ("NEXT_PUBLIC_URL", "PUBLIC"), ("PORT", "OTHER"))]


def test_scripts(found):
    assert sorted(found["scripts"]) == [("build.tool", "scripts/build.tool.ts", "file", []), ("db", "scripts/db", "dir", ["a.ts", "b.ts"])]


def test_libs(found):
    assert sorted(found["libs"]) == [("empty", "src/libs/empty", []), ("trpc", "src/libs/trpc", ["client.tsx", "server.ts"])]


def test_services(found):
    assert sorted(r for r in found["services"] if r[1] != "lib/never/x.ts") == [("AuthService", "src/services/auth.service.ts", ["logIn", "token"]), ("Bad", "utils/bad.ts", []), ("Tool", "utils/x.tsx", [])]


def test_hooks(found):
    assert sorted(found["hooks"]) == [("useB", "hooks/useZ.ts", ["y", "z"]), ("useZ", "hooks/useZ.ts", ["a", "rest"])]


def test_nothing(spark):
    files = spark.createDataFrame([], "path string, content string")
    got = {k: df.collect() for k, df in scanner.scan_repository(files).items()}
    assert tuple(got.pop("framework")[0]) == ("unknown", "JavaScript", False, None, "npm")
    assert tuple(got.pop("structure")[0]) == ({}, {}, [], [], False, {}, None)
    assert tuple(got.pop("i18n")[0]) == (None, [], [], 0, [], None)
    assert tuple(got.pop("auth")[0]) == ([], None, None, [], [], None, [])
    assert set(map(str, got.pop("packages")[0])) == {"None", "[]", "False"}
    assert not any(got.values())
