"""Sources: uploaded files, images, PDFs, zip listings, label files, run metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.operators import dataset

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def is_image_path(path: Column) -> Column:
    """Image extension in any case, without the shadow files that some systems leave."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$") & ~name.startswith("._") & (name != ".DS_Store")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, content) of all files below a folder; unused columns are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).where(is_image_path(F.col("path")))


def is_pdf(path: Column, content: Column, mimetype: Column | None = None) -> Column:
    found = F.lower(path).endswith(".pdf") | (F.substring(content, 1, 4) == F.lit(b"%PDF"))
    return found if mimetype is None else F.coalesce(mimetype == "application/pdf", F.lit(False)) | found


def split_of(path: Column) -> Column:
    """train or val by the folder a file lies in."""
    return F.when(path.rlike("/train/"), "train").when(path.rlike("/val/"), "val")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header of a JPEG; None if there is none."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_jpeg_size(df: DataFrame) -> DataFrame:
    """Adds width and height of JPEG contents (null where unreadable)."""

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        found = [jpeg_size(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({"width": pd.array([f and f[0] for f in found], dtype="Int32"), "height": pd.array([f and f[1] for f in found], dtype="Int32")})

    return df.withColumn("_s", sizes("content")).select("*", "_s.width", "_s.height").drop("_s")


class PdfReader(Protocol):
    """Opens PDF bytes: the number of pages, a page's text, a page's picture (H, W, 3; BGR)."""

    def pages(self, content: bytes) -> int: ...
    def text(self, content: bytes, page: int) -> str: ...
    def image(self, content: bytes, page: int, zoom: float) -> np.ndarray: ...


def pdf_pages(df: DataFrame, reader: PdfReader) -> DataFrame:
    """(path, page_no, page_count, text, error): a row a page, one with an error for a file that does not open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    n = reader.pages(bytes(content))
                    if not n:
                        raise ValueError("PDF has no pages")
                    rows += [(path, k + 1, n, reader.text(bytes(content), k), None) for k in range(n)]
                except Exception as e:  # a broken file is a row
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "page_count", "text", "error"]).astype({"page_no": "Int32", "page_count": "Int32"})

    return df.select("path", "content").mapInPandas(run, "path string, page_no int, page_count int, text string, error string")


def pdf_text(pages: DataFrame, page: int = 1, most: int = 3) -> DataFrame:
    """(path, text, page_count): one page, its number clamped, or for 0 the first ``most`` pages that are not blank."""
    good = pages.where("error is null")
    if page > 0:
        return good.where(F.col("page_no") == F.least(F.greatest(F.lit(page), F.lit(1)), F.col("page_count"))).select("path", "text", "page_count")
    parts = F.array_sort(F.collect_list(F.when((F.col("page_no") <= most) & (F.trim("text") != ""), F.struct("page_no", "text"))))
    return good.groupBy("path", "page_count").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text")).select("path", "text", "page_count")


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of label files: (stem, cls, cx, cy, w, h)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(stem(F.input_file_name()).alias("stem"), "value")
    return dataset.parse_labels(lines)


def annotation_files(spark: SparkSession, path: str) -> DataFrame:
    return dataset.parse_annotations(spark.read.text(path))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class): the non-blank lines of a class file, in order."""
    whole = spark.read.option("wholetext", "true").text(path)
    names = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")
    return whole.select(F.posexplode(names).alias("class_id", "class"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def run_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """(run, row, epoch, metric) of CSV files of training runs, headers trimmed; runs without the metric are null."""
    raw = spark.read.option("header", "true").csv(glob)
    df = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns], F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"))
    metric = dataset.metric_column(df.columns)
    value = F.col(f"`{metric}`") if metric else F.lit(None).cast("string")
    return df.select("run", F.monotonically_increasing_id().alias("row"), F.trim("epoch").alias("epoch"), F.trim(value).alias("metric"))


def decode_images(df: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Adds height, width, n_channels, data and error; what does not decode is kept with its error."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "height int, width int, n_channels int, data binary, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                try:
                    a = decode(bytes(content))
                    out.append((a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, np.ascontiguousarray(a).tobytes(), None))
                except Exception as e:  # quarantined, not fatal
                    out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            for k, c in enumerate(("height", "width", "n_channels", "data", "error")):
                pdf[c] = [x[k] for x in out]
            yield pdf.astype({"height": "Int32", "width": "Int32", "n_channels": "Int32"})

    return df.mapInPandas(run, schema)
