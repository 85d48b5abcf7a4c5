"""Helpers shared by the operators: tables, shared scratch space and column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, delete, merged, shared_dir, small_batches  # noqa: F401  used by the operators from here

#: Words as the contracts define them.
NON_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [None if t is None else press.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def packed(rows: DataFrame) -> DataFrame:
    """rows with ``text`` compressed, for shuffles: it takes half of what it takes there otherwise."""
    return rows.mapInArrow(_press, ", ".join(f"{c} {'binary' if c == 'text' else kind}" for c, kind in rows.dtypes))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the texts that :func:`packed` compressed."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [None if z is None else plain.decompress(z).decode() for z in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def with_sub(docs: DataFrame, scratch: Scratch, id_col: str = "id", text_col: str = "text", sub: str = "sub") -> DataFrame:
    """docs with ``sub``, which together with the id tells texts apart: a hash of the text where the id is
    null (odd) or has several texts (even), else 0. Rows equal in id and text are equal in both."""
    hashed, id_, zero = F.xxhash64(F.col(text_col)), F.col(id_col), F.lit(0).cast("long")
    texts = docs.where(id_.isNotNull()).groupBy(id_.alias("_tessera_many")).agg(F.min(hashed).alias("least"), F.max(hashed).alias("most"))
    many = scratch.save(texts.where("least != most").select("_tessera_many"), "many")
    by_text = F.when(id_.isNull(), hashed.bitwiseOR(F.lit(1)))
    if many.isEmpty():
        return docs.withColumn(sub, F.coalesce(by_text, zero))
    joined = docs.join(merged(many), id_ == F.col("_tessera_many"), "left")
    even = F.when(F.col("_tessera_many").isNotNull(), hashed.bitwiseAND(F.lit(-2)))
    return joined.select(*[F.col(c) for c in docs.columns if c != sub], F.coalesce(by_text, even, zero).alias(sub))


def with_key(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str = "text", key: str = "_tessera_key") -> DataFrame:
    """docs with one number for each id and text: the id, or a hash of both where it is null or has several texts."""
    docs = with_sub(docs, scratch, id_col, text_col, "_tessera_sub")
    own = F.when(F.col("_tessera_sub") == 0, F.col(id_col).cast("long")).otherwise(F.xxhash64(F.col(id_col), F.col("_tessera_sub")))
    return docs.withColumn(key, own).drop("_tessera_sub")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
