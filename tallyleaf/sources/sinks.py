"""Sinks: JSON results, label files by split, class files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.functions import values as V


def json_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_envelope(records: DataFrame, checks: str = "checks", overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): fields, checks as they were, and history; edits of (doc_id, field, value) win."""
    df = records
    if overrides is not None:
        wide = overrides.groupBy("doc_id").pivot("field", list(V.FIELDS)).agg(F.first("value"))
        wide = wide.select("doc_id", *[F.col(f).alias(f"_{f}") for f in V.FIELDS])
        df = df.join(wide, "doc_id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in V.FIELDS})
    history = F.col("history") if "history" in df.columns else F.array().cast("array<struct<label:string,description:string>>")
    return df.select("doc_id", F.to_json(F.struct(F.struct(*V.FIELDS).alias("fields"), F.col(checks).alias("fieldChecks"), history.alias("history"))).alias("json"))


def label_files(df: DataFrame, path: str) -> None:
    """Label lines (split, image, class_id, line) as text by split and image, empty where a line is null."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "line"))), lambda x: x["line"]), "\n")
    df.groupBy("split", "image").agg(lines.alias("value")).write.mode("overwrite").partitionBy("split", "image").text(path)


def class_file(spark: SparkSession, path: str, names=V.CLASSES) -> None:
    spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def dataset_yaml(root: str, names=V.CLASSES) -> str:
    return "\n".join([f"path: {root}", "train: images/train", "val: images/val", "names:", *[f"  {k}: {n}" for k, n in enumerate(names)], ""])
