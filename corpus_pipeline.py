"""From raw documents to token files: language, near duplicates, benchmark leaks, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the last
return the columns of documents. Empty inputs pass through every stage; null texts are rejected by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, language, mixing, token_files
from tessera.llm.common import Scratch, merged, table, with_key

#: Below this share of the best language a text is of no language in particular.
LEAST_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, or whose best language has less than half of the score."""
    model = language.train(docs.where(~language.fold()))
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 keep the one of least id.

    Rows equal in id and text are one document, of which one row stays. Documents whose id is null, or the id of
    several texts, are told apart by a hash, which stands for the id. Documents without words stay."""
    scratch = Scratch(spark, "groups")
    keyed = with_key(docs, scratch, "doc_id")
    groups = jaccard.jaccard_groups(keyed.select("_tessera_key", "text"), id_col="_tessera_key", words=5, num=80, den=100)
    first = scratch.save(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_tessera_keep")).agg(F.count("*").alias("_tessera_rows")), "first")
    kept = keyed.join(merged(first.select("_tessera_keep")), F.col("_tessera_key") == F.col("_tessera_keep"), "left_semi")
    if not first.where("_tessera_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["_tessera_key"])
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs. Rows are judged each by itself, whatever their id."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in id, text and source share their copies evenly."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row for each emitted copy, also of rows with null or repeated ids."""
    return token_files.tokenize_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: A language model and a tokenizer are no SQL; the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.save(out, name)
    return docs
