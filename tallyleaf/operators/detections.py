"""Detections: external JSON, labels, boxes, and the choice of one crop a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.functions import values as V
from tallyleaf.operators import pages

#: Superset of the keys that external detectors use.
ITEM = "struct<label:string,class:string,name:string,category:string,class_id:string,confidence:double,score:double,conf:double,box:array<double>,bbox:array<double>,xyxy:array<double>,bbox_format:string>"


def field_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.ALIASES.items() for x in pair])
    key = F.trim(label)
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.lower(key)), key)


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> list[Column]:
    left = F.greatest(F.lit(0), F.least(F.lit(width - 1), half_even(x1)))
    top = F.greatest(F.lit(0), F.least(F.lit(height - 1), half_even(y1)))
    right = F.greatest(left + 1, F.least(F.lit(width), half_even(x2)))
    bottom = F.greatest(top + 1, F.least(F.lit(height), half_even(y2)))
    return [left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")]


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def from_json(df: DataFrame, payload: str, width: int, height: int, least: float = 0.0) -> DataFrame:
    """(doc_id, det_no, label, field, confidence, x1..y2) of detector output, a list or an object with one.

    Items without a box are left out; a score of at most 1 is a share.
    """
    text = F.col(payload)
    whole = F.from_json(text, f"struct<detections:array<{ITEM}>>")
    items = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{ITEM}>")).otherwise(whole["detections"])
    rows = df.select("doc_id", F.posexplode(items).alias("det_no", "d"))
    d = F.col("d")
    label = F.coalesce(*[filled(d[k]) for k in ("label", "class", "name", "category", "class_id")], F.lit(""))
    score = F.coalesce(d["confidence"], d["score"], d["conf"], F.lit(0.0))
    box = F.coalesce(d["box"], d["bbox"], d["xyxy"])
    shift = d["bbox_format"].eqNullSafe(F.lit("xywh"))
    at = [F.get(box, F.lit(k)) for k in range(4)]
    far = [F.when(shift, at[0] + at[2]).otherwise(at[2]), F.when(shift, at[1] + at[3]).otherwise(at[3])]
    out = rows.where(F.size(box) >= 4).select("doc_id", "det_no", label.alias("label"), field_of(label).alias("field"), F.round(F.when(score <= 1, score * 100).otherwise(score), 2).alias("confidence"), *clipped(at[0], at[1], far[0], far[1], width, height))
    return out.where(F.col("confidence") >= 100 * least)


def with_centres(crops: DataFrame) -> DataFrame:
    """Crops have doc_id, det_no, field, confidence, x1..y2, text, ocr_confidence."""
    base = F.col("confidence") + F.when(F.coalesce("text", F.lit("")) != "", 15).otherwise(0) + 0.05 * F.coalesce("ocr_confidence", F.lit(0.0))
    return crops.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "h": F.col("y2") - F.col("y1"), "base": base})


def best_per_field(crops: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("base"), "det_no")
    return with_centres(crops).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def has_tax_id(c: Column) -> Column:
    # most texts are too short for one
    return F.when(F.char_length(F.coalesce(c, F.lit(""))) < 15, False).otherwise(F.coalesce(c, F.lit("")).rlike("(?i)(?<![0-9A-Z])[0-9A-Z]{15,20}(?![0-9A-Z])"))


def noisy_seller(c: Column) -> Column:
    return T.let(T.squeeze(c), lambda t: T.contains_any(t, V.SELLER_NOISE))


#: What a page's crops hold: number, field, confidence, box, text and the score of its OCR.
CROP = ("det_no", "field", "confidence", "x1", "y1", "x2", "y2", "text", "ocr_confidence")


def crop_facts(x: Column) -> Column:
    """A crop with its text cleaned and its place; what only some fields ask of a text is found where they are chosen."""
    return T.let(
        T.clean_crop(x["text"]),
        lambda text: F.struct(
            x["det_no"].alias("det_no"),
            x["field"].alias("field"),
            x["confidence"].alias("confidence"),
            *[x[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
            text.alias("text"),
            F.coalesce(x["ocr_confidence"], F.lit(0.0)).alias("ocr_confidence"),
            ((x["x1"] + x["x2"]) / 2).alias("cx"),
            ((x["y1"] + x["y2"]) / 2).alias("cy"),
            (x["y2"] - x["y1"]).alias("h"),
            (x["confidence"] + F.when(text != "", 15).otherwise(0) + 0.05 * F.coalesce(x["ocr_confidence"], F.lit(0.0))).alias("base"),
        ),
    )


def best_crop(items: Column, score: pages.Rule, strict: pages.Rule | None = None) -> Column:
    """The crop of the best score, the first of equals.

    Crops that meet ``strict`` come before all others, which is how a filter
    falls back to the crops it left out.
    """
    rest = (lambda x: F.when(F.coalesce(strict(x), F.lit(False)), 0).otherwise(1)) if strict else (lambda x: F.lit(0))
    return pages.first_by(items, lambda x: [rest(x), -score(x), x["det_no"]])


def resolve_pages(df: DataFrame, height: float, crops: str = "crops") -> DataFrame:
    """Adds ``resolved``: the crops of a page as fields, in the order in which a parser should read them.

    First the crop chosen for each field, amount and tax put right if crossed,
    in the order of the classes; then all other crops with text from top to
    bottom.  Each is (field, det_no, source, confidence, box, text, chosen),
    where source is the field that the detector named.  Crops without text are
    left out; a page without crops, or with null for them, has none.
    """
    keep = df.columns
    df = df.withColumn("_c", F.coalesce(F.transform(crops, crop_facts), F.array()))
    of = lambda f: pages.where(F.col("_c"), lambda x: x["field"] == f)
    upper, lower = (lambda x: 20 * (1 - x["cy"] / height)), (lambda x: x["cy"] / height * 20)
    base = lambda x: x["base"]
    with_upper = lambda x: x["base"] + upper(x)
    paid = lambda x: F.when(T.has_money(x["text"]), 1).otherwise(0)
    has_id = lambda x: has_tax_id(x["text"])
    checksum = best_crop(of("checksum"), base)
    df = df.withColumns(
        {
            **{f"_{f}": best_crop(of(f), with_upper) for f in ("invoice_type", "invoice_code", "invoice_no", "invoice_date")},
            "_drawer": best_crop(of("drawer"), base),
            "_checksum": checksum,
            "_total": best_crop(of("total"), lambda x: x["base"] + x["cy"] / height * 35 + 25 * paid(x)),
            "_buyer_tax_id": best_crop(of("buyer_tax_id"), lambda x: with_upper(x) + F.when(has_id(x), 30).otherwise(0), has_id),
        }
    )
    total_y = F.coalesce(F.col("_total")["cy"], F.lit(0.75 * height))

    def money(f: str) -> Column:
        gap = lambda x: F.greatest(F.lit(0.0), 30 - F.abs(total_y - x["cy"]) / height * 100)
        return best_crop(of(f), lambda x: x["base"] + gap(x) + F.when(x["cy"] < total_y, 20).otherwise(-25) + 20 * paid(x) + x["cy"] / height * 10)

    over = F.col("_buyer_tax_id")["cy"] + 0.2 * F.col("_buyer_tax_id")["h"]
    below = lambda c: F.col(c)["cy"] - 0.2 * F.col(c)["h"]
    quiet = pages.where(of("seller_name"), lambda x: ~noisy_seller(x["text"]))
    df = df.withColumns(
        {
            "_checksum": F.when(T.has_checksum(F.col("_checksum")["text"]), F.col("_checksum")),
            "_a": money("amount"),
            "_x": money("tax"),
            "_buyer_name": best_crop(of("buyer_name"), with_upper, lambda x: F.coalesce(x["cy"] < over, F.lit(True))),
            "_seller_name": best_crop(quiet, lambda x: x["base"] + lower(x), lambda x: F.coalesce(x["cy"] > below("_total"), F.lit(True))),
        }
    )
    bound = F.coalesce(below("_seller_name"), below("_total"))
    low = lambda x: F.coalesce(x["cy"] > bound, F.lit(True)) & has_id(x)
    a, x = F.col("_a"), F.col("_x")
    crossed = F.coalesce((F.abs(a["cy"] - x["cy"]) <= 1.5 * F.greatest(a["h"], x["h"])) & (a["cx"] > x["cx"]), F.lit(False))
    df = df.withColumns(
        {
            "_seller_tax_id": best_crop(of("seller_tax_id"), lambda x: x["base"] + lower(x) + F.when(has_id(x), 30).otherwise(0), low),
            "_amount": F.when(crossed, x).otherwise(a),
            "_tax": F.when(crossed, a).otherwise(x),
        }
    )
    row = lambda x, field, chosen: F.struct(field.alias("field"), x["det_no"].alias("det_no"), x["field"].alias("source"), x["confidence"].alias("confidence"), *[x[c].alias(c) for c in ("x1", "y1", "x2", "y2")], x["text"].alias("text"), chosen.alias("chosen"))
    taken = F.array(*[F.when(F.col(f"_{f}")["text"] != "", row(F.col(f"_{f}"), F.lit(f), F.lit(True))) for f in V.CLASSES])
    df = df.withColumn("_taken", F.filter(taken, lambda x: x.isNotNull()))
    numbers = F.transform("_taken", lambda x: x["det_no"])
    rest = pages.where(F.col("_c"), lambda x: (x["text"] != "") & ~F.array_contains(numbers, x["det_no"]))
    rest = F.array_sort(F.transform(rest, lambda x: F.struct(x["y1"], x["x1"], -x["confidence"], x["det_no"], row(x, x["field"], F.lit(False)).alias("row"))))
    return df.withColumn("resolved", F.concat("_taken", F.transform(rest, lambda x: x["row"]))).select(*keep, "resolved")


def crop_pages(crops: DataFrame) -> DataFrame:
    return pages.collected(crops, CROP, "crops")


def resolve(crops: DataFrame, height: float) -> DataFrame:
    """(doc_id, field, det_no, text): the crop chosen for each field."""
    # with inline a filter on the array's size would be pushed down, with all that makes the array in it
    rows = resolve_pages(crop_pages(crops), height).select("doc_id", F.inline_outer("resolved"))
    return rows.where("chosen").select("doc_id", "field", "det_no", "text")


def leftovers(crops: DataFrame, chosen: DataFrame) -> DataFrame:
    """Crops with text that no field took, with their ``place`` from top to bottom."""
    rest = crops.where(T.clean_crop(F.col("text")) != "").join(chosen.select("doc_id", "det_no"), ["doc_id", "det_no"], "left_anti")
    down = Window.partitionBy("doc_id").orderBy("y1", "x1", F.desc("confidence"), "det_no")
    return rest.withColumn("place", F.row_number().over(down) - 1)


def field_label(field: Column) -> Column:
    """The words by which a text names a field; other names stay."""
    table = F.create_map(*[F.lit(x) for label, f in V.LABELS.items() for x in (f, label)])
    return F.coalesce(F.try_element_at(table, field), field)


def detected_text(resolved: Column, base_text: Column | None = None) -> Column:
    """What a parser reads: a line 'label:text' for each resolved crop with text, then the text of the whole page."""
    lines = F.transform(resolved, lambda x: T.let(T.clean_crop(x["text"]), lambda t: F.when(t != "", F.concat(field_label(x["field"]), F.lit(":"), t))))
    lines = F.filter(lines, lambda x: x.isNotNull())
    if base_text is not None:
        given = F.coalesce(base_text, F.lit(""))
        lines = F.concat(lines, F.when(given != "", F.array(F.lit("OCR全文:"), given)).otherwise(F.array().cast("array<string>")))
    return F.array_join(lines, "\n")


def best_variant(results: DataFrame) -> DataFrame:
    """The result of each document with the best score, the first variant of equals, with its rivals."""
    rivals = F.array_sort(F.collect_list(F.struct("variant_no", "score")))
    best = results.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("variant_no")).alias("v"))).alias("best"), rivals.alias("candidates"))
    return best.select("doc_id", (-F.col("best.v")).alias("variant_no"), F.col("best.score").alias("score"), "candidates")


def ocr_score(filled_keys: Column, completeness: Column, confidence: Column, size: Column) -> Column:
    return 18 * filled_keys + 60 * completeness + 0.25 * confidence + 0.01 * F.least(size, F.lit(800))


def mean_confidence(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean of the non-negative confidences, to two decimals, 0.0 if there is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.round(F.avg(F.when(F.col(value) >= 0, F.col(value))), 2), F.lit(0.0)).alias("average_confidence"))
