"""Incremental ingest of text files: an extension beyond the batch operators.

A drop folder is read as a stream; its checkpoint takes the place of looking
up which files were done.  Records and checks are the batch expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyleaf.operators import fusion, validate


def invoice_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """(path, text) of whole files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.current_timestamp().alias("seen"))


def parsed(stream: DataFrame) -> DataFrame:
    return validate.validate(fusion.parse(stream))


def without_reuploads(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each text once within the delay."""
    return stream.withColumn("digest", F.sha2("text", 256)).withWatermark("seen", delay).dropDuplicatesWithinWatermark(["digest"])


def level_counts(stream: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Levels of the total's check by window."""
    return stream.withWatermark("seen", delay).groupBy(F.window("seen", size), F.col("checks.total.level").alias("level")).count()


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has arrived, then stops; a restart goes on after it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
