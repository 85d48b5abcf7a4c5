"""Incremental refresh of a repository's tables, as a batch job or for each micro-batch of a file stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import embedding
from ..operators import chunks, graph, sync, typescript
from ..sources.files import TableStore


@dataclass
class Report:
    """What a refresh did. ``mode`` is none, incremental or full; sizes are those of the tables afterwards."""

    mode: str
    changed: int = 0
    deleted: int = 0
    affected: int = 0
    rejected: int = 0
    created: dict[str, int] = field(default_factory=dict)
    removed: dict[str, int] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)


def _delta(report: Report, name: str, old: DataFrame | None, new: DataFrame, key: list[str]) -> None:
    """Counts of keys that came and went."""
    report.sizes[name] = new.count()
    before = None if old is None else old.select(*key)
    report.created[name] = report.sizes[name] if before is None else new.select(*key).join(before, key, "left_anti").count()
    report.removed[name] = 0 if before is None else before.join(new.select(*key), key, "left_anti").count()


def refresh(files: DataFrame, store: TableStore, threshold: float = 0.20, force: bool = False, complete: bool = True, provider: str | None = None) -> Report:
    """Bring the tables of ``store`` up to date with (path, content).

    *incremental*: rows of changed and deleted files are replaced, those of others stay. *full* (forced, or too
    many changes): every file is read again and nothing of the old tables stays. Unless ``complete``, files that are
    absent count as unchanged, and the mode is always incremental. With a ``provider`` the vectors of chunks
    follow: those of chunks that are gone or have another text go, only new texts are embedded. The
    snapshot is written last, so a job that dies is done again.
    """
    spark = files.sparkSession
    now, before = sync.snapshot(files), store.read("snapshot")
    if before is None:
        before = spark.createDataFrame([], "path string, hash string")
    ops = sync.diff(now, before)
    if not complete:
        ops = ops.where("op = 'changed'")
    ops = ops.cache()
    try:
        n = ops.agg(F.count_if(F.col("op") == "changed").alias("c"), F.count_if(F.col("op") == "deleted").alias("d")).first()
        if not (n["c"] or n["d"] or force):
            return Report("none")
        mode = sync.mode(n["c"] + n["d"], now.count(), threshold, force) if complete else "incremental"
        report = Report(mode, n["c"], n["d"])
        full = mode == "full"
        changed = now.select("path") if full else ops.where("op = 'changed'").select("path")
        gone = ops.select(F.col("path").alias("file"))
        fresh = typescript.extract_files(files.join(changed, "path", "left_semi")).persist()
        kept = lambda old, rows: rows if full or old is None else old.join(gone, "file", "left_anti").select(*rows.columns).unionByName(rows)
        for name in schemas.AST:
            old = store.read(name)
            store.write(kept(old, typescript.relation(fresh, name)), name)
            report.sizes[name] = store.read(name).count()
        report.rejected = typescript.rejects(fresh).count()
        fresh.unpersist()
        rel = {name: store.read(name) for name in schemas.AST}
        known = now if full else sync.upsert(before.join(ops, "path", "left_anti").select("path", "hash"), now.join(changed, "path", "left_semi").select("path", "hash"), ["path"])
        targets = graph.resolve_imports(rel["imports"], known)
        report.affected = sync.affected(ops, targets, rel["calls"], rel["functions"]).join(ops.where("op = 'deleted'"), "path", "left_anti").count()
        nodes, edges = graph.build(rel["imports"], rel["functions"], rel["components"], rel["types"], rel["hooks"], rel["calls"], files=known)
        for name, table, key in (("nodes", nodes, ["label", "key"]), ("edges", edges, graph.EDGE_COLUMNS)):
            old = store.read(name)
            store.write(table, name)
            _delta(report, name, old, store.read(name), key)
        made = chunks.create(*(rel[x].join(changed.select(F.col("path").alias("file")), "file", "left_semi") for x in ("functions", "components", "types")), rel["imports"], files)
        old = store.read("chunks")
        store.write(kept(old, made), "chunks")
        _delta(report, "chunks", old, store.read("chunks"), ["id"])
        if provider:
            old = store.read("vectors")
            store.write(embedding.index(store.read("chunks"), old, provider), "vectors")
            _delta(report, "vectors", old, store.read("vectors"), ["id", "text_hash"])
        store.write(known, "snapshot")
        return report
    finally:
        ops.unpersist()


def follow(files: DataFrame, store: TableStore, checkpoint: str, order: str = "modified", provider: str | None = None, **options) -> StreamingQuery:
    """Run :func:`refresh` on each micro-batch of a stream of (path, content, modified); of several contents of
    a path the last by ``order`` counts, among equals (or without such a column) the greatest."""

    def batch(rows: DataFrame, _: int) -> None:
        place = F.struct(*([order] if order in rows.columns else []), "content")
        refresh(rows.groupBy("path").agg(F.max_by("content", place).alias("content")), store, complete=False, provider=provider)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).options(**options).start()
