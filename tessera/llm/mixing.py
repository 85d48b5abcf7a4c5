"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` of all words; a target stops at ``most`` times its source's size, and what is cut off is
shared again by weight until no target is above. With all sources open at a common level the fixed
point is ``min(most * size, level * weight)``, found by sorting sources by size / weight.

Sampling: within a source every document expects ``target / size`` copies. The running sum of
expected copies, shifted by one random offset of the source, crosses integers; a document is emitted
once for each crossing. Documents lie in order of size, so every stretch of sizes gets its share and
a source's words come within about one document of the target. As all documents of a source expect
the same number r, the sum before the i-th is i * r, and only ranks are needed.

Ranks without gathering a source: documents (without text) are range-partitioned by (source, size,
doc_id), written, numbered inside each partition, and shifted by the counts of earlier partitions.

Defined results: a null text has size 0; null is a source of its own; an empty source has target 0;
repeated rows are separate documents; the sources, one row each, are ranked in one task; ties in (source, size, doc_id) are equal rows, whose order
changes nothing in size; an empty table gives an empty mix; input columns named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import NON_SPACE_WORDS, Scratch, merged, partitions, table, with_key

WEIGHTS = (3, 1, 2)


def _offset(source, seed: int):
    """One number in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) to (source, source_size, target, rate). One row a source, so one task ranks them."""
    sizes.createOrReplaceTempView("_tessera_sizes")
    weight = "CASE (rank - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    return sizes.sparkSession.sql(TARGETS.format(weight=weight, share=share, most=most))


#: Also part of the check in SQL. lvl: the level if all sources before this one are full and the others open. It holds where
#: this one is not above its limit, and the largest that holds fills no source in vain.
TARGETS = """
WITH ranked AS (SELECT source, size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM _tessera_sizes),
     weighed AS (SELECT source, CAST(size AS DOUBLE) AS size, CAST({weight} AS DOUBLE) AS w, rank FROM ranked),
     sums AS (SELECT *, sum(size) OVER (ORDER BY size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS full_before,
                     sum(w) OVER () - (sum(w) OVER (ORDER BY size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w) AS open_w,
                     sum(size) OVER () AS total FROM weighed),
     levels AS (SELECT *, ({share}e0 * total - {most}e0 * full_before) / open_w AS lvl FROM sums),
     cut AS (SELECT *, max(CASE WHEN lvl * w <= {most}e0 * size THEN lvl END) OVER () AS level FROM levels)
SELECT source, CAST(size AS BIGINT) AS source_size, least({most}e0 * size, level * w) AS target,
       CASE WHEN size > 0 THEN least({most}e0, level * w / size) ELSE 0e0 END AS rate
FROM cut
"""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc id, source, size, source_size, target, copies, taken) for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(NON_SPACE_WORDS)), F.lit(0)).cast("long").alias("size"))
    sized = scratch.save(rows, "sizes")
    ranged = sized.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last(), "size", "doc_id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id")
    numbered = scratch.save(ranged.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "order")
    parts = scratch.save(numbered.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words")), "parts")
    by_source = targets(parts.groupBy("source").agg(F.sum("words").alias("size")), share, most)
    parts.createOrReplaceTempView("_tessera_parts")
    base = spark.sql("SELECT source AS s, part AS p, first, sum(n) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM _tessera_parts")
    base = base.join(by_source, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    base = scratch.save(base, "base")
    joined = numbered.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank = F.col("before") + F.col("at") - F.col("first")
    u = _offset(F.col("source"), seed)
    copies = F.floor((rank + 1) * F.col("rate") + u) - F.floor(rank * F.col("rate") + u)
    out = joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows equal in id, text and source share their copies evenly."""
    scratch = Scratch(docs.sparkSession, "mixed")
    keyed = with_key(docs, scratch, id_col, text_col)
    taken = mix(keyed, "_tessera_key", text_col, source_col, **options)
    taken = taken.groupBy(F.col("doc_id").alias("_tessera_id"), F.col("source").alias("_tessera_source")).agg(F.sum("copies").alias("_tessera_copies"), F.count("*").alias("_tessera_rows"))
    taken = scratch.save(taken.where("_tessera_copies > 0"), "taken")
    joined = keyed.join(merged(taken), (F.col("_tessera_key") == F.col("_tessera_id")) & keyed[source_col].cast("string").eqNullSafe(F.col("_tessera_source")))
    if not taken.where("_tessera_rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("_tessera_key", "_tessera_source").orderBy(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")])))
        share = lambda n: F.floor(n * F.col("_tessera_copies") / F.col("_tessera_rows"))
        joined = joined.withColumn("_tessera_nth", nth).withColumn("_tessera_copies", share(F.col("_tessera_nth")) - share(F.col("_tessera_nth") - 1)).where("_tessera_copies > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.col("_tessera_copies").cast("long"))
    return joined.withColumn("_tessera_copy", F.explode(copies)).select(*[F.col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


_W = "CASE (rank - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
OP8_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
     _tessera_sizes AS (SELECT source, sum(size) AS size FROM sized GROUP BY source),
     t AS ({TARGETS.format(weight=_W, share=1.5, most=2.0)}),
     o AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS rank,
                  CAST(('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM sized)
SELECT o.doc_id, o.size, t.source_size, t.target,
       CAST((floor((rank + 1) * rate + u) - floor(rank * rate + u)) * o.size AS BIGINT) AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
