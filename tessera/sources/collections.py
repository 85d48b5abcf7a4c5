"""Collections of vectors: a fixed dimension and metric, upserts, filters and deletion over versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import search, sync
from .files import TableStore

#: Metrics by name; any other name means the first (fixed values).
METRICS = ("cosine", "euclid", "dot")


class Collection:
    """Points (id, text, metadata columns, embedding) of one dimension."""

    def __init__(self, store: TableStore, name: str = "code"):
        self.store, self.name = store, name

    def _meta(self) -> dict | None:
        meta = self.store.read(f"{self.name}_info")
        return None if meta is None else json.loads(meta.first()["info"])

    def exists(self) -> bool:
        return self._meta() is not None

    def create(self, dimension: int | None, distance: str = "Cosine") -> None:
        if not dimension or dimension < 1:
            raise ValueError("a collection needs the dimension of its vectors")
        metric = distance.lower() if distance.lower() in METRICS else METRICS[0]
        info = [(json.dumps({"dimension": dimension, "metric": metric}),)]
        self.store.write(self.store.spark.createDataFrame(info, "info string"), f"{self.name}_info")

    def drop(self) -> None:
        self.store.drop(self.name)
        self.store.drop(f"{self.name}_info")

    def points(self) -> DataFrame | None:
        return self.store.read(self.name)

    def upsert(self, points: DataFrame) -> int:
        """New points replace those of their id, in one write; returns how many there are."""
        meta = self._meta()
        if meta is None:
            raise ValueError(f"no collection {self.name}")
        counts = points.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.size("embedding") == meta["dimension"], F.lit(False))).alias("bad")).first()
        if counts["bad"]:
            raise ValueError(f"{counts['bad']} vectors are not of dimension {meta['dimension']}")
        if counts["n"]:
            old = self.points()
            self.store.write(points if old is None else sync.upsert(old.select(*points.columns) if set(points.columns) <= set(old.columns) else old, points, ["id"]), self.name)
        return counts["n"]

    def delete(self, condition: Column) -> int:
        """Delete the points that meet a condition; returns how many."""
        old = self.points()
        if old is None:
            return 0
        gone = old.where(condition).count()
        if gone:
            self.store.write(old.where(~F.coalesce(condition, F.lit(False))), self.name)
        return gone

    def delete_files(self, files: DataFrame) -> int:
        """Delete the points of these files (path)."""
        old = self.points()
        if old is None:
            return 0
        kept = old.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti")
        gone = old.count() - kept.count()
        if gone:
            self.store.write(kept.select(*old.columns), self.name)
        return gone

    def info(self) -> dict | None:
        meta, points = self._meta(), self.points()
        return None if meta is None else {"name": self.name, "points": 0 if points is None else points.count(), **meta}

    def search(self, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
        meta, points = self._meta(), self.points()
        if meta is None or points is None:
            raise ValueError(f"no points in {self.name}")
        return search.top_k(points, query, k, "id", where=where, metric=meta["metric"])
