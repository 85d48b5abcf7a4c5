"""Embedding providers: a registry of functions from texts to vectors, run on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], np.ndarray]
_PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    _PROVIDERS[name] = provider


def provider(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown embedding provider {name}; there are {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name]


def hashing(texts: list[str], dimension: int = 384) -> np.ndarray:
    """Signed hashed words and word pairs, of unit length: the same text gives the same vector everywhere."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = re.findall(r"[A-Za-z]+|\d+", text.lower())
        for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            row[h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(row)
        if norm:
            row /= norm
    return out


register("hashing", hashing)


class AuthError(Exception):
    """The provider refuses the key."""


@dataclass(frozen=True)
class HttpProvider:
    """Vectors from an HTTP service that takes {"model", "input": [texts]} and answers with "embeddings", "embedding" or "data".

    Texts go in batches; time-outs, failed connections, 429 and 5xx are tried again after waits that
    double, 401 and 403 never are, nor any other refusal."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)
    batch: int = 32
    timeout: float = 60
    attempts: int = 3
    least_wait: float = 1.0
    most_wait: float = 10.0

    def __post_init__(self) -> None:
        if not self.model:
            raise ValueError("an embedding provider needs the name of a model")

    def _post(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.loads(answer.read())
        if "data" in found:
            vectors = [x["embedding"] for x in sorted(found["data"], key=lambda x: x.get("index", 0))]
        else:
            vectors = found["embeddings"] if "embeddings" in found else [found["embedding"]]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    def __call__(self, texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            for attempt in range(1, self.attempts + 1):
                try:
                    out += self._post(texts[i : i + self.batch])
                    break
                except urllib.error.HTTPError as e:
                    if e.code in (401, 403):
                        raise AuthError(f"{self.url} answers {e.code}") from e
                    if attempt == self.attempts or e.code != 429 and e.code < 500:
                        raise
                except (urllib.error.URLError, TimeoutError, ConnectionError):
                    if attempt == self.attempts:
                        raise
                time.sleep(min(self.most_wait, self.least_wait * 2 ** (attempt - 1)))
        return np.array(out, np.float32)


#: Errors that a summary lists.
MOST_ERRORS = 100


def attempt(chunks: DataFrame, provider: Provider, batch: int = 32) -> DataFrame:
    """chunks (id, text, ...) with ``embedding`` and ``error``. A batch that fails is tried again text by text, so that one
    bad text costs no other; what still fails has a null vector and an error. Runs where the chunks lie."""
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return provider([text])[0].tolist(), None
        except Exception as e:  # reported for each chunk
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, found = frame["text"].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    found += [(v.tolist(), None) for v in provider(some)]
                except Exception:
                    found += [one(t) for t in some]
            yield frame.assign(embedding=pd.Series([v for v, _ in found], index=frame.index, dtype=object), error=pd.Series([e for _, e in found], index=frame.index, dtype=object))

    return chunks.mapInPandas(run, schema)


@dataclass
class Summary:
    """What an indexing run did."""

    total_chunks: int = 0
    embedded: int = 0
    stored: int = 0
    skipped: int = 0
    failed: int = 0
    errors: list[dict] = field(default_factory=list)
    duration_seconds: float = 0.0
    types: dict[str, int] = field(default_factory=dict)

    def __str__(self) -> str:
        return f"{self.stored} of {self.total_chunks} chunks stored in {self.duration_seconds:.1f} s (skipped {self.skipped}, failed {self.failed})"


def index_codebase(chunks: DataFrame, collection, provider: Provider | str = "hashing", force: bool = False, batch: int = 32, dimension: int | None = None) -> Summary:
    """Embed chunks into a collection (``sources.collections.Collection``), which is made if need be, of the dimension given or found.

    Chunks whose id and text are stored are skipped; with ``force`` the collection begins anew. A failure
    ends the run with a partial summary, whose last error tells it."""
    began, out = time.time(), Summary()
    try:
        run = _PROVIDERS[provider] if isinstance(provider, str) else provider
        if force and collection.exists():
            collection.drop()
        rows = chunks.withColumn("text_hash", F.sha2("text", 256))
        out.types = {r["chunk_type"]: r["n"] for r in rows.groupBy("chunk_type").agg(F.count("*").alias("n")).collect()}
        out.total_chunks = sum(out.types.values())
        if out.total_chunks:
            if not collection.exists():
                collection.create(dimension or len(run([rows.orderBy("id").first()["text"]])[0]))
            old = collection.points()
            if old is not None:
                rows = rows.join(old.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h")), (F.col("id") == F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_anti")
            tried = attempt(rows, run, batch).withColumn("indexed_at", F.current_timestamp()).persist()
            try:
                n = tried.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
                out.skipped, out.failed, out.embedded = out.total_chunks - n["n"], n["bad"], n["n"] - n["bad"]
                out.errors = [{"chunk_id": r["id"], "error": r["error"]} for r in tried.where("error is not null").select("id", "error").orderBy("id").limit(MOST_ERRORS).collect()]
                out.stored = collection.upsert(tried.where("error is null").drop("error"))
            finally:
                tried.unpersist()
    except Exception as e:
        out.errors.append({"error": f"indexing failed: {type(e).__name__}: {e}"})
    out.duration_seconds = time.time() - began
    return out


def embed(text: Column | str, provider: str = "hashing") -> Column:
    run = _PROVIDERS[provider]

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(run(s.fillna("").tolist())))

    return vectors(text)


def index(chunks: DataFrame, stored: DataFrame | None = None, provider: str = "hashing") -> DataFrame:
    """Chunks with vectors. Those whose id and text are stored already keep their vector and are not embedded anew."""
    rows = chunks.withColumn("text_hash", F.sha2("text", 256))
    if stored is None:
        return rows.withColumn("embedding", embed("text", provider))
    old = stored.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "embedding")
    same = (F.col("id") == F.col("i")) & (F.col("text_hash") == F.col("h"))
    kept = rows.join(old, same).select(*rows.columns, "embedding")
    new = rows.join(old, same, "left_anti").withColumn("embedding", embed("text", provider))
    return kept.unionByName(new)
