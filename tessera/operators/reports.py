"""Reports of what was found: each table in its order, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by which each table is shown in order.
ORDERS = {
    "routes": ("type", "route", "file"),
    "components": ("name", "file"),
    "services": ("service", "file"),
    "stores": ("store",),
    "trpc_routers": ("tier", "router"),
    "server_modules": ("module",),
    "llm_providers": ("provider",),
    "sso_providers": ("provider",),
    "env_vars": ("category", "position"),
    "hooks": ("name",),
    "scripts": ("name",),
    "libs": ("lib",),
    "database": ("orm",),
}


def ordered(name: str, rows: DataFrame) -> DataFrame:
    known = [c for c in ORDERS.get(name, ()) if c in rows.columns]
    return rows.orderBy(*known) if known else rows


def first_names(names, n: int):
    """The first n of a list as text, with how many more there are."""
    shown = F.array_join(F.slice(names, 1, n), ", ")
    return F.when(F.size(names) > n, F.concat(shown, F.lit(" (+"), (F.size(names) - n).cast("string"), F.lit(")"))).otherwise(shown)


def text(rows: DataFrame, most: int = 1000) -> str:
    """A table as aligned text; of longer tables the first ``most`` rows and how many there are."""
    found = rows.limit(most + 1).collect()
    cell = lambda v: ", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v)
    lines = [rows.columns, *[[cell(v) for v in r] for r in found[:most]]]
    widths = [max(len(x[i]) for x in lines) for i in range(len(rows.columns))]
    out = ["  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip() for x in lines]
    return "\n".join([out[0], "  ".join("-" * w for w in widths), *out[1:], *([f"... {rows.count()} rows in all"] if len(found) > most else [])])


def report(found: dict[str, DataFrame]) -> str:
    """All tables of a scan that have rows."""
    parts = []
    for name, rows in found.items():
        body = text(ordered(name, rows))
        if body.count("\n") > 1:
            parts.append(f"{name}\n{body}")
    return "\n\n".join(parts)
