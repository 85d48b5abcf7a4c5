"""Code chunks: windows of source lines after each definition, with metadata, deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Lines taken for each kind of definition, and most characters of a chunk (fixed values).
LINES = {"function": 50, "component": 60, "type": 30}
MOST = 2000


def of_relation(rows: DataFrame, files: DataFrame, chunk_type: str) -> DataFrame:
    """Chunks of one relation; rows without file or line (and, but for functions, name) are left out."""
    kept = rows.where("file is not null and line is not null" + ("" if chunk_type == "function" else " and name is not null"))
    # split below the join, once a file: above it Spark would repeat the split wherever body and lead stand
    src = files.select(F.col("path").alias("file"), S.lines_of("content").alias("_lines"))
    joined = kept.select("file", F.coalesce("name", F.lit("anonymous")).alias("name"), "line", "exported").join(src, "file")
    body = S.lines_from("_lines", F.col("line"), LINES[chunk_type])
    lead = F.when(F.col("line") > 3, S.lines_from("_lines", F.col("line") - 3, 3)).otherwise("")
    body = F.when(lead.contains("/**") | lead.contains("//"), F.concat(lead, F.lit("\n"), body)).otherwise(body)
    text, cut = S.truncated("body", MOST)
    named = joined.withColumn("body", body).where("body != ''")
    return named.select(F.concat_ws(":", "file", F.lit(chunk_type), "name", F.col("line").cast("string")).alias("id"), text.alias("text"), "file", "line", F.lit(chunk_type).alias("chunk_type"), "name", "exported", S.infer_feature("file").alias("feature"), S.language_of("file").alias("language"), cut.alias("truncated"))


def dedup(chunks: DataFrame, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """One chunk an id: the first exported one by ``order``, else the first. Partial sums, so hot ids gather nothing."""
    first = F.struct(~F.coalesce(F.col("exported"), F.lit(False)), *order)
    best = chunks.groupBy("id").agg(F.min_by(F.struct(*chunks.columns), first).alias("c"))
    return best.select("c.*")


def by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def with_dependencies(chunks: DataFrame, imports: DataFrame, file: str = "file") -> DataFrame:
    lists = imports.groupBy(file).agg(F.array_sort(F.collect_set("source")).alias("dependencies"))
    return chunks.join(lists, file, "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))


def payload(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"text_length": F.length("text"), "has_docstring": F.col("text").contains("/**") | F.col("text").contains('"""'), "line_count": F.size(F.split("text", "\n"))})


def create(functions: DataFrame, components: DataFrame, types: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    rows = of_relation(functions, files, "function").unionByName(of_relation(components, files, "component")).unionByName(of_relation(types, files, "type"))
    return payload(with_dependencies(dedup(rows), imports))
