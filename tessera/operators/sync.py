"""Incremental refresh: snapshots, change sets, affected files, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, op): changed if new or of another hash, deleted if gone; equal files do not appear."""
    a, b = now.select("path", F.col("hash").alias("new")), before.select("path", F.col("hash").alias("old"))
    both = a.join(b, "path", "full_outer")
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("path", F.when(F.col("new").isNull(), "deleted").otherwise("changed").alias("op"))


def affected(changed: DataFrame, imports: DataFrame, calls: DataFrame, functions: DataFrame, depth: int = 1) -> DataFrame:
    """Changed files, files that import them, and files that call a function defined in them."""
    out = changed.select("path").distinct()
    for _ in range(depth):
        importers = imports.join(out, imports["target"] == out["path"], "left_semi").select(F.col("file").alias("path"))
        names = functions.join(out, functions["file"] == out["path"], "left_semi").select(F.col("name").alias("callee"), F.col("file").alias("def_file")).distinct()
        callers = calls.join(names, "callee").where("file != def_file").select(F.col("file").alias("path"))
        out = out.union(importers).union(callers).distinct()
    return out


def merge(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str, by_prefix: bool = False) -> DataFrame:
    """Rows of unchanged owners stay, rows of changed owners come from ``fresh``; equal rows once.

    With ``by_prefix`` an owner is also a folder of a changed path: each path is joined by equality with all of its folders."""
    paths = changed.select(F.col("path").alias("_path"))
    if by_prefix:
        parts = F.split("_path", "/")
        paths = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_path"))
    paths = paths.distinct()
    kept = old.join(paths, old[key] == paths["_path"], "left_anti")
    return kept.unionByName(fresh.join(paths, fresh[key] == paths["_path"], "left_semi"), allowMissingColumns=True).distinct()


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def mode(changed: int, total: int, threshold: float = 0.20, force: bool = False) -> str:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    share = changed / total if total else 1.0
    return "full" if force or share > threshold else "incremental"


def first_of_each(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the first by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def distinct_entries(rows: DataFrame, ordinal: str) -> DataFrame:
    """Rows equal in all columns but the ordinal, the first of each."""
    rest = [c for c in rows.columns if c != ordinal]
    return rows.groupBy(*rest).agg(F.min(ordinal).alias(ordinal)).select(*rows.columns)
