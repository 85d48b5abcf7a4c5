"""Command line: ``python -m tessera COMMAND --path REPOSITORY``. Results are tables below the store's folder."""

from __future__ import annotations

import argparse
import json
import logging
import os
import subprocess
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, schemas, settings
from .functions import embedding
from .operators import chunks, graph, reports, scanner, search, typescript
from .sources import files as sources
from .sources.collections import Collection
from .streaming.refresh import refresh

log = logging.getLogger("tessera")


def session(s: settings.Settings) -> SparkSession:
    spark = SparkSession.builder.appName("tessera").master(os.environ.get("SPARK_MASTER", s.master)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Commands:
    """One method a command; each prints its report and returns an exit code."""

    def __init__(self, args: argparse.Namespace, s: settings.Settings, spark: SparkSession | None = None):
        self.args, self.s, self._spark = args, s, spark
        self.path = os.path.abspath(getattr(args, "path", None) or s.repo_path)

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = session(self.s)
        return self._spark

    @property
    def store(self) -> sources.TableStore:
        root = self.s.store if "://" in self.s.store or os.path.isabs(self.s.store) else os.path.join(self.path, self.s.store)
        return sources.TableStore(self.spark, root if "://" in root else f"file://{root}")

    @property
    def collection(self) -> Collection:
        return Collection(self.store, self.s.collection)

    def files(self) -> DataFrame:
        if not os.path.isdir(self.path):
            raise FileNotFoundError(f"no folder {self.path}")
        return sources.scan(self.spark, f"file://{self.path}", excluded=(*sources.EXCLUDED, os.path.basename(self.s.store)))

    def status(self) -> int:
        for name, value in [("version", __version__), *((f, getattr(self.s, f)) for f in ("store", "log_level", "master", "collection", "embedding_provider"))]:
            print(f"{name:20} {value}")
        return 0

    def version(self) -> int:
        print(f"tessera {__version__}")
        return 0

    def scan_repo(self) -> int:
        files = self.files().persist()
        found = scanner.scan_repository(files)
        store = self.store
        for name, rows in found.items():
            store.write(rows, f"scan_{name}")
        stored = {name: store.read(f"scan_{name}") for name in found}
        store.write(scanner.summarize(stored), "scan_summary")
        self._summary(store.read("scan_summary"))
        if self.args.verbose:
            print("\n" + reports.report(stored))
        files.unpersist()
        return 0

    def _summary(self, rows: DataFrame) -> None:
        for name, value in rows.first().asDict().items():
            print(f"{name:24} {', '.join(value) if isinstance(value, list) else value}")

    def summarize_repo(self) -> int:
        rows = self.store.read("scan_summary")
        if rows is None:
            print("nothing scanned yet: run scan-repo", file=sys.stderr)
            return 1
        self._summary(rows)
        return 0

    def index_code(self) -> int:
        out = typescript.extract_files(sources.typescript(self.files())).persist()
        store = self.store
        for name in schemas.AST:
            store.write(typescript.relation(out, name), name)
            print(f"{name:12} {store.read(name).count()}")
        print(f"{'rejected':12} {typescript.rejects(out).count()}")
        out.unpersist()
        return 0

    def sync_repo(self) -> int:
        provider = None if self.args.skip_embeddings or not self.s.sync_update_embeddings else self.s.embedding_provider
        files = sources.typescript(self.files()).select("path", "content")
        done = refresh(files, self.store, self.s.sync_fallback_threshold, force=self.args.full, provider=provider)
        if done.mode == "none":
            print("no changes")
            return 0
        print(f"mode {done.mode}: {done.changed} changed, {done.deleted} deleted, {done.affected} affected, {done.rejected} rejected")
        for name, size in done.sizes.items():
            print(f"{name:12} {size} rows" + (f", {done.created[name]} created, {done.removed[name]} removed" if name in done.created else ""))
        return 0

    def build_graph(self) -> int:
        store = self.store
        store.validate(list(schemas.AST), self.s.sync_max_age_seconds)
        rel = {name: store.read(name) for name in schemas.AST}
        scans = {x: store.read(f"scan_{x}") for x in ("routes", "services", "stores")}
        nodes, edges = graph.build(rel["imports"], rel["functions"], rel["components"], rel["types"], rel["hooks"], rel["calls"], **scans)
        store.write(nodes, "nodes")
        store.write(edges, "edges")
        print(reports.text(graph.Graph(store.read("nodes"), store.read("edges")).totals().orderBy("kind", "name")))
        return 0

    def query_graph(self) -> int:
        store = self.store
        print(reports.text(graph.Graph(store.read("nodes"), store.read("edges")).query(self.args.sql)))
        return 0

    def index_embeddings(self) -> int:
        store = self.store
        store.validate(["functions", "components", "types", "imports"], 0)
        made = chunks.create(*(store.read(x) for x in ("functions", "components", "types", "imports")), sources.typescript(self.files()))
        done = embedding.index_codebase(made, self.collection, settings.provider(self.s), self.args.force, self.s.embedding_batch_size, self.s.vector_dimension)
        print(done)
        for e in done.errors[:5]:
            print(f"  {e.get('chunk_id', '')} {e['error']}")
        return 1 if done.errors and not done.stored and not done.skipped else 0

    def search_code(self) -> int:
        began = time.time()
        vector = settings.provider(self.s)([self.args.query])[0].tolist()
        kept = search.Filters(chunk_type=self.args.type, exported_only=self.args.exported, file_pattern=self.args.file)
        points = self.collection.points()
        if points is None:
            print("nothing indexed yet: run index-embeddings", file=sys.stderr)
            return 1
        hits = search.search_code(points, vector, self.args.limit, kept)
        if self.args.format == "context":
            print(search.context_text(hits))
        elif self.args.format == "code":
            for r in hits.collect():
                print(f"{r['file']}:{r['line']} {r['name']}\n{r['text']}\n")
        else:
            print(reports.text(hits.select("file", "line", "name", "chunk_type", F.round("adjusted_score", 3).alias("score"))))
        print(f"{(time.time() - began) * 1000:.0f} ms")
        return 0

    def embedding_status(self) -> int:
        info = self.collection.info()
        print("no collection" if info is None else "\n".join(f"{k:12} {v}" for k, v in info.items()))
        return 0 if info else 1

    def clear_embeddings(self) -> int:
        if not self.args.force and input(f"delete collection {self.s.collection}? [y/N] ").strip().lower() not in ("y", "yes"):
            print("kept")
            return 1
        self.collection.drop()
        print("deleted")
        return 0

    def run_task(self) -> int:
        done = subprocess.run(self.args.command_line, shell=True, cwd=self.args.cwd, capture_output=True, text=True)
        print(json.dumps({"exit_code": done.returncode, "stdout": done.stdout, "stderr": done.stderr}))
        return done.returncode


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, path: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        if path:
            p.add_argument("--path", help="the repository")
        return p

    add("status", "settings", False)
    add("version", "version", False)
    add("scan-repo", "run all detectors").add_argument("--verbose", action="store_true", help="also print the tables")
    add("summarize-repo", "summary of the last scan")
    add("index-code", "extract the relations of all TypeScript files")
    p = add("sync-repo", "bring all tables up to date")
    p.add_argument("--full", action="store_true", help="read every file again")
    p.add_argument("--skip-embeddings", action="store_true")
    add("build-graph", "nodes and edges of the extracted relations")
    add("query-graph", "SQL over {nodes} and {edges}").add_argument("sql")
    add("index-embeddings", "chunk and embed").add_argument("--force", action="store_true", help="begin anew")
    p = add("search-code", "search by meaning")
    p.add_argument("query")
    p.add_argument("--limit", "-n", type=int, default=10)
    p.add_argument("--file", help="pattern of paths")
    p.add_argument("--type", choices=sorted(chunks.LINES))
    p.add_argument("--exported", action="store_true")
    p.add_argument("--format", choices=("table", "code", "context"), default="table")
    add("embedding-status", "size, dimension and metric of the collection")
    add("clear-embeddings", "delete the collection").add_argument("--force", "-f", action="store_true", help="do not ask")
    p = add("run-task", "run a shell command", False)
    p.add_argument("command_line")
    p.add_argument("--cwd")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, environ: dict[str, str] | None = None) -> int:
    args, s = parser().parse_args(argv), settings.load(environ)
    logging.basicConfig(level=s.log_level)
    try:
        return getattr(Commands(args, s, spark), args.command.replace("-", "_"))()
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
