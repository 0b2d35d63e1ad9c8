"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.llm import decontaminate, fill_middle, importance, licences, line_dedup, ngram_join, pieces, pii, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity
from tallyleaf.llm.common import documents, fold_of, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def with_fold(scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=(5, 0))
    return with_fold(toxicity.score(docs, model), 5, 0)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), fold=(4, 2))
    return with_fold(quality_model.score(docs, model, 0.7), 4, 2)


def op7_rules(spark: SparkSession, sf_dir: str, threshold: float = -0.35) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")), threshold)


def op8_pieces(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return pieces.encode_digest(documents(spark, sf_dir), model_file or pieces.model_path())


def op9_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("n_removed_lines").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts are plain with n 0, equal rows give equal rows."""
    return fill_middle.digest(documents(spark, sf_dir))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; texts of fewer than 20 words (null: none) lose nothing, equal rows are one document."""
    return substring_dedup.digest(documents(spark, sf_dir))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; without words n_features and weight are 0, ties of the score go to the smaller doc_id."""
    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_licences": licences.op3_licences,
        "op4_suffix": op4_suffix,
        "op5_leaks": op5_leaks,
        "op6_quality": op6_quality,
        "op7_rules": op7_rules,
        "op8_pieces": op8_pieces,
        "op9_join": op9_join,
        "op10_lines": op10_lines,
        "op11_middle": op11_middle,
        "op12_substrings": op12_substrings,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.oracle(), "op11_middle": fill_middle.oracle(), "op13_resample": importance.oracle()}
