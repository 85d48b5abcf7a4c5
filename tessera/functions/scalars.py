"""Scalar expressions of the engine. All are built-in column expressions, so they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as text editors count them, for splitting whole files.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def import_kind(source: Column | str) -> Column:
    s = _c(source)
    return F.when(s.startswith("./") | s.startswith("../"), "relative").when(s.startswith("@") | s.startswith("~"), "alias").otherwise("external")


#: Directories that name a feature, in order of priority (fixed values).
FEATURE_DIRS = ("features", "routes", "components", "app", "pages")


def infer_feature(path: Column | str) -> Column:
    """The directory below the first of FEATURE_DIRS that the path has, by priority and not by position."""
    p = _c(path)
    return F.coalesce(*[F.nullif(F.regexp_extract(p, rf"(?:^|/){d}/([^/]+)/", 1), F.lit("")) for d in FEATURE_DIRS])


def truncated(text: Column | str, most: int) -> tuple[Column, Column]:
    """(text cut to ``most`` characters with '...' after it, whether it was cut)."""
    t = _c(text)
    long = F.length(t) > most
    return F.when(long, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t), F.coalesce(long, F.lit(False))


def language_of(path: Column | str) -> Column:
    p = F.lower(_c(path))
    return F.when(p.endswith(".tsx"), "tsx").when(p.endswith(".ts"), "typescript").otherwise("unknown")


def clean_version(raw: Column | str) -> Column:
    """The version behind range signs; what has no such form is only trimmed."""
    t = F.trim(_c(raw))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^[\^~>=<\s]*(\d+\.\d+[\w.\-]*)", 1), F.lit("")), t)


def pascal_case(stem: Column | str) -> Column:
    parts = F.filter(F.split(_c(stem), r"[._-]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def normal_path(path: Column | str) -> Column:
    return F.ltrim(F.translate(_c(path), "\\", "/"), F.lit("/"))


def stem(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column | str, pattern: str) -> Column:
    return _c(path).rlike(glob_regex(pattern))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def preview(text: Column | str, lines: int = 3, width: int = 120) -> Column:
    full = F.filter(F.split(_c(text), "\n"), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(F.slice(full, 1, lines), lambda x: F.when(F.length(x) > width, F.concat(F.left(x, F.lit(width)), F.lit("..."))).otherwise(x)), "\n")


def lines_of(text: Column | str) -> Column:
    """The lines of a text; an end of line at its end begins no other."""
    parts = F.split(_c(text), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_from(lines: Column | str, first: Column, count: int) -> Column:
    """Lines ``first`` (from 1) to ``first + count - 1``; past the end they are cut off, a bad start gives ''."""
    lines = _c(lines)
    return F.when((first >= 1) & (first <= F.size(lines)), F.array_join(F.slice(lines, first.cast("int"), count), "\n")).otherwise("")


def source_lines(text: Column | str, first: Column, count: int) -> Column:
    """As :func:`lines_from`, of a text."""
    return lines_from(lines_of(text), first, count)


#: Name prefixes of environment variables by category, the first that fits (fixed values).
ENV_CATEGORIES = (
    ("LLM", ("OPENAI_", "AZURE_", "ANTHROPIC_", "GOOGLE_", "GROQ_", "MISTRAL_", "PERPLEXITY_", "OLLAMA_", "OPENROUTER_", "ZHIPU_", "MOONSHOT_", "MINIMAX_", "DEEPSEEK_", "QWEN_", "CLOUDFLARE_", "SILICONCLOUD_", "TOGETHERAI_", "ZEROONE_", "AWS_", "FAL_")),
    ("AUTH", ("NEXT_AUTH_", "NEXT_PUBLIC_CLERK_", "CLERK_", "AUTH_", "NEXTAUTH_")),
    ("DATABASE", ("DATABASE_", "KEY_VAULTS_", "DB_")),
    ("S3", ("S3_", "DOC_S3_", "MINIO_")),
    ("OBSERVABILITY", ("SENTRY_", "POSTHOG_", "VERCEL_ANALYTICS_", "LOGFLARE_", "LOGTO_")),
    ("PUBLIC", ("NEXT_PUBLIC_",)),
)


def env_category(name: Column | str) -> Column:
    out = F.lit("OTHER")
    for category, prefixes in reversed(ENV_CATEGORIES):
        out = F.when(_c(name).rlike("^(" + "|".join(prefixes) + ")"), category).otherwise(out)
    return out


#: HTTP methods in the order in which they are reported (fixed values).
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def canonical_methods(found: Column | str) -> Column:
    return F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.array_contains(_c(found), m))


def route_of(directory: Column | str) -> Column:
    """Directory below the app folder to (route, type, slot): a fold over its segments.

    ``@slot`` begins anew below the slot, an intercept ``(.)x`` begins anew at x, a ``(group)`` adds
    nothing, ``[variants]`` is kept as such, and any other segment is appended.
    """
    begin = F.struct(F.lit("").alias("route"), F.lit("page").alias("type"), F.lit(None).cast("string").alias("slot"))

    def step(s: Column, x: Column) -> Column:
        make = lambda route, kind, slot: F.struct(route.alias("route"), kind.alias("type"), slot.alias("slot"))
        intercept = F.regexp_extract(x, r"^\(\.{1,3}\)(?:\(\.{2}\))*(.+)$", 1)
        return (
            F.when(x == "", s)
            .when(x.startswith("@"), make(F.lit(""), F.lit("parallel"), x))
            .when(intercept != "", make(F.concat(F.lit("/"), intercept), F.lit("intercepted"), s["slot"]))
            .when(x.rlike(r"^\(.*\)$"), s)
            .when(x == "[variants]", make(s["route"], F.lit("variants_dynamic"), s["slot"]))
            .otherwise(make(F.concat(s["route"], F.lit("/"), x), s["type"], s["slot"]))
        )

    return F.aggregate(F.split(_c(directory), "/"), begin, step, lambda s: F.struct(F.when(s["route"] == "", "/").otherwise(s["route"]).alias("route"), s["type"].alias("type"), s["slot"].alias("slot")))
