"""Engines: OCR and detectors as plug-ins run over images, and the recognition route.

An OCR engine maps an image to lines, a detector to boxes; both are plain
callables, made once in each worker.  Errors are rows, not failures.
"""

from __future__ import annotations

import json
import shlex
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.operators import detections, fusion
from tallyleaf.operators.raster import PROCESSORS

Line = tuple[str, float, tuple[float, float, float, float]]
Ocr = Callable[[np.ndarray], list[Line]]
Detector = Callable[[np.ndarray], list[dict]]
LINES = "doc_id string, line_no int, text string, score double, x1 double, y1 double, x2 double, y2 double, error string"
BOXES = "doc_id string, det_no int, label string, confidence double, box array<double>, error string"

_LIVE: dict[str, Callable] = {}


def once(key: str, make: Callable[[], Callable]) -> Callable:
    """The engine of this worker for a key (name, model path, thresholds)."""
    if key not in _LIVE:
        _LIVE[key] = make()
    return _LIVE[key]


def image_of(row: pd.Series) -> np.ndarray:
    a = np.frombuffer(row["data"], dtype=np.uint8)
    shape = (int(row["height"]), int(row["width"]), int(row["n_channels"]))
    return a.reshape(shape if shape[2] > 1 else shape[:2])


def percent(v: float) -> float:
    return v * 100 if v <= 1 else v


def recognize_lines(images: DataFrame, key: str, make: Callable[[], Ocr]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = once(key, make)
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                try:
                    rows += [(str(r["doc_id"]), k, t, percent(float(s)), *map(float, b), None) for k, (t, s, b) in enumerate(ocr(image_of(r)))]
                except Exception as e:  # kept as a row
                    rows.append((str(r["doc_id"]), None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")]).astype({"line_no": "Int32"})

    return images.mapInPandas(run, LINES)


def detect(images: DataFrame, key: str, make: Callable[[], Detector], least: float = 0.35) -> DataFrame:
    """Boxes with (doc_id, det_no, label, field, confidence, x1..y2) at or over a share of confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = once(key, make)
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                try:
                    rows += [(str(r["doc_id"]), k, str(d["label"]), percent(float(d["confidence"])), [float(x) for x in d["box"]], None) for k, d in enumerate(found(image_of(r)))]
                except Exception as e:  # kept as a row
                    rows.append((str(r["doc_id"]), None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "det_no", "label", "confidence", "box", "error"]).astype({"det_no": "Int32"})

    boxes = images.mapInPandas(run, BOXES).where("error is null")
    size = images.select(F.col("doc_id").cast("string").alias("doc_id"), "width", "height")
    at = [F.get("box", F.lit(k)) for k in range(4)]
    met = boxes.join(size, "doc_id").where(F.col("confidence") >= 100 * least)
    left, top = F.greatest(F.lit(0), F.least(F.col("width") - 1, F.bround(at[0], 0).cast("int"))), F.greatest(F.lit(0), F.least(F.col("height") - 1, F.bround(at[1], 0).cast("int")))
    return met.select(
        "doc_id",
        "det_no",
        "label",
        detections.field_of(F.col("label")).alias("field"),
        F.round("confidence", 2).alias("confidence"),
        left.alias("x1"),
        top.alias("y1"),
        F.greatest(left + 1, F.least(F.col("width"), F.bround(at[2], 0).cast("int"))).alias("x2"),
        F.greatest(top + 1, F.least(F.col("height"), F.bround(at[3], 0).cast("int"))).alias("y2"),
    )


def external(command: str, encode: Callable[[np.ndarray], bytes], timeout: int = 180) -> Callable[[], Detector]:
    """A detector that is another program: '{input}' and '{output}' in its command are files; no shell."""

    def make() -> Detector:
        def run(image: np.ndarray) -> list[dict]:
            with tempfile.TemporaryDirectory() as d:
                with open(f"{d}/in.png", "wb") as f:
                    f.write(encode(image))
                argv = [a.format(input=f"{d}/in.png", output=f"{d}/out.json") for a in shlex.split(command)]
                subprocess.run(argv, check=True, timeout=timeout, capture_output=True)
                with open(f"{d}/out.json") as f:
                    found = json.load(f)
            return found["detections"] if isinstance(found, dict) else found

        return run

    return make


def route(df: DataFrame, text: str = "text", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rows whose text will do, rows that need OCR), so no engine sees the former."""
    long = F.char_length(T.squeeze(F.col(text))) >= least
    return df.where(long), df.where(~long)


def decision(text: Column) -> Column:
    """Why a detector is or is not used."""
    t = T.squeeze(text)
    return (
        F.when(t == "", "未识别到足够表头文本，使用普通 OCR")
        .when(t.rlike("电子发票|数电|全电"), "电子发票/数电票，使用普通 OCR 或 PDF 文本直读")
        .when(T.is_detector_suitable(text), "识别为扫描/拍照版增值税普通发票，启用 YOLO 辅助定位")
        .otherwise("非 YOLO 训练主类型，使用普通 OCR")
    )


def detector_mode(value: str) -> str:
    v = (value or "").strip().lower()
    return "force" if v in ("true", "1", "yes", "yolo", "force") else "auto" if v == "auto" else "off"


def recognize_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Records of rows with text: fields, completeness, full confidence, and a score."""
    rec = fusion.parse(df, text).withColumn("completion_score", fusion.completion())
    return rec.withColumns({"average_confidence": F.lit(100.0), "score": 100 * F.col("completion_score") + 35, "route": F.lit("skipped_pdf_text")})


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n) for n, k in enumerate(PROCESSORS)], "key string, place int")


def lineage(history: Column, label: str, description: str) -> Column:
    """History with a step appended."""
    return F.array_append(history, F.struct(F.lit(label).alias("label"), F.lit(description).alias("description")))
