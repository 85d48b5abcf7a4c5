"""Source trees, change sets and artifacts as DataFrames; table sinks."""

from __future__ import annotations

import subprocess
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Directories that are never part of a source tree (fixed values).
EXCLUDED = ("node_modules", ".next", "dist", "build", "out", ".git", ".repo_intelligence")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path below root, content, bytes, modified) of all files; text that is not UTF-8 gives null content."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.col("path"), "^(?:file:)?/*", "/")
    rel = F.when(path.startswith(base + "/"), F.expr(f"substring(regexp_replace(path, '^(?:file:)?/*', '/'), {len(base) + 2})")).otherwise(path)
    rows = found.select(rel.alias("path"), F.col("content").alias("bytes"), F.col("modificationTime").alias("modified"))
    text = F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded)))).select("path", text.alias("content"), "bytes", "modified")


def typescript(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").rlike(r"\.tsx?$"))


def newest(files: DataFrame) -> DataFrame:
    """One row: when the newest of the files was modified."""
    return files.agg(F.max("modified").alias("newest"))


def packages(files: DataFrame) -> DataFrame:
    """(file, package, version, section) of every dependency in package.json files."""
    sections = ("dependencies", "devDependencies", "peerDependencies")
    maps = F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>").alias("m")) for s in sections])
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.col("path").alias("file"), F.explode(maps).alias("s"))
    return rows.select("file", "s.section", F.explode("s.m").alias("package", "version"))


def first_existing(files: DataFrame, candidates: list[str]) -> DataFrame:
    """The first candidate path that exists: ordered probe by rank."""
    ranked = files.sparkSession.createDataFrame(list(enumerate(candidates)), "rank int, candidate string")
    hit = files.join(F.broadcast(ranked), F.col("path") == F.col("candidate"))
    return hit.groupBy().agg(F.min_by("path", "rank").alias("path"), F.min_by("content", "rank").alias("content")).where("path is not null")


def status_changes(lines: DataFrame) -> DataFrame:
    """``git status --porcelain`` lines (column value) to (path, op); a rename deletes the old path and changes the new."""
    code, rest = F.substring("value", 1, 2), F.expr("trim(substring(value, 4))")
    unquote = lambda c: F.trim(c, F.lit('"'))
    pair = F.split(rest, " -> ")
    item = lambda p, op: F.struct(unquote(p).alias("path"), F.lit(op).alias("op"))
    both = F.when(code.contains("R") & (F.size(pair) == 2), F.array(item(pair[0], "deleted"), item(F.get(pair, 1), "changed")))
    one = F.when(code.contains("D"), F.array(item(rest, "deleted"))).otherwise(F.array(item(rest, "changed")))
    return lines.select(F.explode(F.coalesce(both, one)).alias("x")).select("x.*").where(F.lower("path").rlike(r"\.tsx?$")).distinct()


def name_status_changes(lines: DataFrame) -> DataFrame:
    """``git diff --name-status`` lines to (path, op)."""
    f = F.split("value", "\t")
    item = lambda p, op: F.struct(p.alias("path"), F.lit(op).alias("op"))
    rows = F.when(f[0].startswith("R") & (F.size(f) == 3), F.array(item(f[1], "deleted"), item(F.get(f, 2), "changed"))).when(f[0].startswith("D"), F.array(item(f[1], "deleted"))).otherwise(F.array(item(F.get(f, 1), "changed")))
    return lines.select(F.explode(rows).alias("x")).select("x.*").where(F.lower("path").rlike(r"\.tsx?$")).distinct()


def git_changes(spark: SparkSession, repo: str, base_ref: str = "HEAD~1") -> DataFrame:
    """Changes of the working tree, or if there are none those against ``base_ref``."""

    def lines(*args: str) -> DataFrame:
        out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout
        return spark.createDataFrame([(x,) for x in out.splitlines() if x], "value string")

    found = status_changes(lines("status", "--porcelain"))
    return found if not found.isEmpty() else name_status_changes(lines("diff", "--name-status", base_ref))


def read_json(spark: SparkSession, path: str, schema, wrap: bool = False) -> DataFrame:
    """The rows of a JSON artifact, a list of objects; none if it is missing, malformed or no list.
    With ``wrap`` a single object counts as a list of one."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    kind = empty.schema
    text = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("value"))
    many = F.from_json("value", T.ArrayType(kind), {"mode": "PERMISSIVE"})
    one = F.array(F.from_json("value", kind)) if wrap else F.array().cast(T.ArrayType(kind))
    rows = F.when(F.col("value").startswith("["), many).when(F.col("value").startswith("{"), one)
    valid = F.try_parse_json("value").isNotNull()
    return text.where(valid).select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


class TableStore:
    """Versioned tables: each write makes a new version, readers take the newest complete one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not self._fs.exists(path(f"{self.root}/{name}")):
            return []
        found = [s.getPath() for s in self._fs.listStatus(path(f"{self.root}/{name}"))]
        return sorted(p.toString() for p in found if self._fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def write(self, df: DataFrame, name: str, keep: int = 2) -> None:
        n = int(self._versions(name)[-1].rpartition("/v")[2].split("-")[0]) + 1 if self._versions(name) else 0
        df.write.parquet(f"{self.root}/{name}/v{n:08d}-{uuid.uuid4().hex[:8]}")
        for old in self._versions(name)[:-keep]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def read(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        """The newest version; ``default`` if there is none or it has not the default's columns."""
        found = self._versions(name)
        if not found:
            return default
        rows = self.spark.read.parquet(found[-1])
        return rows if default is None or set(default.columns) <= set(rows.columns) else default

    def modified(self, name: str) -> float | None:
        """When the newest version was complete, in seconds."""
        found = self._versions(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return self._fs.getFileStatus(path(f"{found[-1]}/_SUCCESS")).getModificationTime() / 1000 if found else None

    def validate(self, names: list[str], most_seconds: float = 259_200, now: float | None = None) -> None:
        """ValueError if a table is missing, or if the newest of them is older than ``most_seconds`` (0: any age)."""
        times = {n: self.modified(n) for n in names}
        if missing := [n for n, t in times.items() if t is None]:
            raise ValueError("missing tables: " + ", ".join(missing))
        age = (time.time() if now is None else now) - max(times.values())
        if most_seconds and age > most_seconds:
            raise ValueError(f"tables are {age:.0f} seconds old, more than {most_seconds:.0f}")

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

