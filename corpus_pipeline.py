"""The corpus pipeline: five stages from raw documents to a mix of sources.

Each stage works on all that the one before kept, written as Parquet and read
again. STAGES lists them; run applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import decontamination, jaccard, linededup, mixing, toxicity
from sylvan.llm.common import discard, fold_of, free_executors, materialize, small_batches, table


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their types; others are left out."""
    small_batches(docs.sparkSession)
    free_executors(docs.sparkSession)
    types = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def _resized(before: str = "n_chars") -> list:
    return ["doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias(before)]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic go."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)
    return toxicity.score_toxicity(docs, model).where("tox_predicted = 0").select(*docs.columns)


def remove_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are copies of an earlier one go, and documents that consisted of such lines (and blank ones)."""
    return linededup.dedup_lines(_documents(docs), linededup.ALL_LINES).where("n_left is null or n_left > 0").select(*_resized())


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles one stays, the one with the smallest doc_id. Every row is a document, with
    a number of its own while they are compared, so that rows without a doc_id or with the same one are told apart by their texts;
    without shingles, only rows that are equal in doc_id and text are one."""
    docs = _documents(docs)
    numbered = materialize(docs.withColumn("row_no", F.monotonically_increasing_id()), "near-copies")
    found = materialize(jaccard.jaccard_components(numbered.select(F.col("row_no").alias("doc_id"), "text")), "near-copies-found")
    rows = numbered.select("row_no", "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(7)).alias("t2")).join(found.withColumnRenamed("doc_id", "row_no"), "row_no")
    alone = F.col("n_shingles") == 0
    same = [F.when(~alone, F.col("component_id")).alias("c"), F.when(alone, F.coalesce("doc_id", "row_no")).alias("d"), *(F.when(alone, F.col(t)).alias(t) for t in ("t1", "t2")), (alone & F.col("doc_id").isNull()).alias("unnamed")]
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2", "row_no")
    stays = rows.groupBy(*same).agg(F.min(first).alias("first")).select("first.row_no")
    return numbered.join(stays, "row_no", "left_semi").select(*docs.columns)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others benchmark passages are cut out."""
    return decontamination.decontaminate(_documents(docs), table(spark, sf_dir, "benchmark")).select(*_resized())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_report(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_copied_lines),
    ("n-gram Jaccard join", remove_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources to target weights", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
        discard(before)
    return docs
