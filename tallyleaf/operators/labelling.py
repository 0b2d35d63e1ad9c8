"""Labelled datasets from detectors and annotations: label files, copies of originals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import values as V
from tallyleaf.operators import dataset


def joined(lines: Column) -> Column:
    """Lines as the text of a label file: each ends with a line feed, no lines give an empty file."""
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def detected_labels(images: DataFrame, detections: DataFrame, share: float = 0.2, with_confidence: bool = False) -> DataFrame:
    """(image, split, error, detections, classes, label): a label file for each image from what a detector found.

    ``images`` has image (unique), width and height, null where it can't be
    read; ``detections`` has image, det_no, class_id, confidence (a share) and
    x1..y2.  Classes that don't exist and boxes without area are left out.
    The last ``share`` of the images by name is for validation.  An image that
    can't be read has an error and null for the rest; one without detections
    has an empty file.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    good = F.col("class_id").between(0, len(V.CLASSES) - 1) & (x2 > x1) & (y2 > y1)
    found = detections.where(good).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("det_no", "class_id", "x1", "y1", "x2", "y2", "confidence"))).alias("found"))
    placed = dataset.split_by_place(images.select("image", "width", "height"), "image", share).join(found, "image", "left")
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(most - 1.0, v.cast("double")))
    width, height = F.col("width").cast("double"), F.col("height").cast("double")

    def line(d: Column) -> Column:
        made = dataset.label_line(d["class_id"], cut(d["x1"], width), cut(d["y1"], height), cut(d["x2"], width), cut(d["y2"], height), width, height)
        return F.format_string("%s %.6f", made, d["confidence"].cast("double")) if with_confidence else made

    boxes = F.coalesce("found", F.array().cast(placed.schema["found"].dataType))
    names = F.array(*map(F.lit, V.CLASSES))
    read = F.col("width").isNotNull() & F.col("height").isNotNull()
    return placed.select(
        "image",
        "split",
        F.when(~read, "image can't be read").alias("error"),
        F.when(read, F.size(boxes)).alias("detections"),
        F.when(read, F.array_sort(F.array_distinct(F.transform(boxes, lambda d: F.get(names, d["class_id"]))))).alias("classes"),
        F.when(read, joined(F.transform(boxes, line))).alias("label"),
    )


def report(items: DataFrame) -> DataFrame:
    """One row on labelled images (image, split, classes): images, train, val, boxes where counted, and images by class, zeros kept.

    No images give zeros.
    """
    boxes = F.coalesce(F.sum("detections"), F.lit(0)) if "detections" in items.columns else F.lit(0)
    of = lambda c: F.count_if(F.array_contains("classes", c))
    counts = F.map_from_arrays(F.array(*map(F.lit, V.CLASSES)), F.array(*[of(c) for c in V.CLASSES]))
    split = lambda s: F.count_if(F.col("split") == s).alias(s)
    return items.agg(F.count(F.lit(1)).alias("images"), split("train"), split("val"), boxes.cast("bigint").alias("boxes"), counts.alias("class_counts"))


def converted(annotations: DataFrame, sizes: DataFrame) -> DataFrame:
    """(split, image, classes, texts, label): the label file of each annotated image.

    ``annotations`` has split, image and nodes, ``sizes`` has image, width and
    height; images without a size are left out, as they can't be read.  An
    image whose questions say nothing has an empty file.
    """
    known = annotations.join(sizes, "image")
    lines = dataset.convert(known.select("image", "nodes", "width", "height"), F.col("width").cast("double"), F.col("height").cast("double"))
    order = F.array_position(F.array(*map(F.lit, V.CLASSES)), F.col("class"))
    each = lines.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "class", "text", "line"))).alias("l"))
    out = known.select("split", "image").join(each, "image", "left")
    rows = F.coalesce("l", F.array().cast(out.schema["l"].dataType))
    drawn = F.filter(rows, lambda x: x["line"].isNotNull())
    return out.select("split", "image", F.transform(drawn, lambda x: x["class"]).alias("classes"), F.transform(drawn, lambda x: x["text"]).alias("texts"), joined(F.transform(drawn, lambda x: x["line"])).alias("label"))


def originals(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, image, label_file, label): where each original of a dataset goes, and what its label file says.

    ``images`` has split, path (under images/split) and the source's path,
    ``labels`` has split, stem and text.  Label files lie flat, by the name of
    the image without its ending; an image without one gets an empty one.
    """
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), "(?<=.)\\.[^.]*$", "")
    named = images.withColumn("stem", stem)
    met = named.join(labels.select("split", "stem", F.col("text").alias("label")), ["split", "stem"], "left")
    return met.select("source", F.concat_ws("/", F.lit("images"), "split", "path").alias("image"), F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("label_file"), F.coalesce("label", F.lit("")).alias("label"))
