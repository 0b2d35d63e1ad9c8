"""From raw documents to encoded training text: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; the last returns token ids for every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.llm import decontaminate, line_dedup, ngram_join, pieces, quality_model
from tallyleaf.llm.common import table
from tallyleaf.llm.state import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.7)."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs.select(*COLUMNS), model, 0.7)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat an earlier line, near copies included; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id."""
    linked = ngram_join.near_duplicates(docs)
    lead = linked.where("component_id = doc_id or component_id is null").groupBy(F.col("doc_id").alias("lead")).agg(F.count(F.lit(1)).alias("rows"))
    kept = docs.select(*COLUMNS).join(lead, F.col("doc_id").eqNullSafe(F.col("lead")), "left_semi")
    # rows that share a doc_id are rare: only if there are any do equal ones fold into one
    return kept.dropDuplicates(["doc_id", "text"]) if lead.where("rows > 1").limit(1).count() else kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.remove_leaking(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip) of every document that is left."""
    return pieces.encode_digest(docs, pieces.model_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", encoding),
]

#: Stages of trained scores and of model files have no SQL; tests hold operators against brute-force versions, the classifier by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return docs
