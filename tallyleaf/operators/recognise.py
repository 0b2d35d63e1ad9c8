"""A page to its checked record: the text layer, plain OCR, or a detector's crops put in order.

A page is one row: what the caller asked for, the texts that a PDF or OCR gave,
and the page's lines and crops as arrays.  The way a page goes decides which
text is parsed; all pages are then parsed, refined and checked in one
projection, so nothing is scanned twice and no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.functions import values as V
from tallyleaf.operators import detections, engines, fusion, layout, pages, validate

#: Columns of a page besides doc_id.
PAGE = ("mode", "pdf_text", "ocr_text", "ocr_confidence", "detector_error", "lines", "crops")


def page_table(requests: DataFrame, lines: DataFrame, crops: DataFrame) -> DataFrame:
    """Pages from requests (doc_id and what is no array), lines and crops that are rows of their own.

    A page without lines or crops has null for them.
    """
    out = requests.join(layout.line_pages(lines), "doc_id", "left")
    return out.join(detections.crop_pages(crops), "doc_id", "left")


def way(df: DataFrame, least: int = 30) -> Column:
    """Which way a page goes.

    skipped_pdf_text: the PDF's own text will do; off: no detector asked for;
    force: its crops are read; auto: they are read beside the OCR text, which
    names a fitting kind of invoice; auto_skipped: it doesn't; auto_fallback:
    it does, but the detector failed; failed: it was forced and failed.
    """
    mode = F.coalesce("mode", F.lit("off"))
    broken = F.col("detector_error").isNotNull()
    return (
        F.when(F.char_length(T.squeeze(F.col("pdf_text"))) >= least, "skipped_pdf_text")
        .when((mode == "force") & broken, "failed")
        .when(mode == "force", "force")
        .when(mode != "auto", "off")
        .when(~T.is_detector_suitable(F.col("ocr_text")), "auto_skipped")
        .when(broken, "auto_fallback")
        .otherwise("auto")
    )


def reason(label: str) -> Column:
    why = engines.decision(F.col("ocr_text"))
    said = lambda text, *parts: F.format_string(text.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), *parts)
    way_ = F.col("way")
    return (
        F.when(way_ == "skipped_pdf_text", V.MODE_PDF)
        .when(way_ == "off", V.MODE_OFF)
        .when(way_.isin("force", "failed"), V.MODE_FORCED.format(label))
        .when(way_ == "auto_skipped", why)
        .when(way_ == "auto_fallback", said(V.MODE_FELL_BACK, why, F.lit(label), F.col("detector_error")))
        .otherwise(said(V.MODE_USED, why, F.lit(label)))
    )


def mean_of_positive(scores: Column) -> Column:
    """The mean of the scores over zero, to two decimals; null if there is none."""
    good = F.filter(scores, lambda s: s > 0)
    return F.when(F.size(good) > 0, F.round(F.reduce(good, F.lit(0.0), lambda a, s: a + s) / F.size(good), 2))


def recognise(df: DataFrame, height: float, width: float, label: str = "YOLO") -> DataFrame:
    """(doc_id, way, reason, text, the 13 fields, average_confidence, completion_score, score, resolved, checks).

    ``df`` has doc_id and the columns of ``PAGE``; further ones are left aside.
    Null texts read as empty, null arrays as empty pages, a null mode as off,
    a null confidence as 0.  A page that failed has empty fields and score 0.
    """
    df = df.select("doc_id", *PAGE).withColumn("way", way(df))
    cropped = F.col("way").isin("auto", "force")
    df = df.withColumns({"crops": F.when(cropped, F.col("crops")), "lines": F.when(cropped, F.col("lines")), "reason": reason(label)})
    df = layout.with_items(detections.resolve_pages(df, height))
    whole = F.array_join(F.transform("_l", lambda x: x["text"]), "\n")
    own = F.coalesce("ocr_text", F.lit(""))
    base = F.when((F.col("way") == "auto") & (own != ""), own).otherwise(whole)
    crop_score = mean_of_positive(F.transform("crops", lambda x: F.coalesce(x["ocr_confidence"], F.lit(0.0))))
    line_score = mean_of_positive(F.transform("_l", lambda x: F.coalesce(x["score"], F.lit(0.0))))
    confidence = F.when(F.col("way") == "skipped_pdf_text", 100.0).when(F.col("way") == "failed", 0.0).when(cropped, F.coalesce(crop_score, line_score, F.lit(0.0))).otherwise(F.coalesce("ocr_confidence", F.lit(0.0)))
    text = F.when(F.col("way") == "skipped_pdf_text", F.col("pdf_text")).when(F.col("way") == "failed", "").when(cropped, detections.detected_text(F.col("resolved"), base)).otherwise(own)
    df = df.select("doc_id", "way", "reason", "lines", "resolved", confidence.alias("average_confidence"), text.alias("text"))
    df = layout.refine_pages(fusion.parse(df), height, width).drop("lines")
    df = df.withColumn("completion_score", fusion.completion())
    score = F.round(100 * F.col("completion_score") + 0.35 * F.col("average_confidence"), 2)
    return validate.validate(df.withColumn("score", score))
