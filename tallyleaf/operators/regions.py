"""Regions of ink: runs of pixels by row, linked across rows, as boxes.

An image of many pixels has few runs, so everything after the first step works
on intervals: dilation widens them, then the runs of an image meet in one row,
where what touches in the next row is linked and components follow from their
links, for all images of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.operators import raster

RUN = ("img", "r", "lo", "hi")
#: So many pixels or runs of several images are looked at together.
PORTION = 1 << 18


def merged(runs: DataFrame, gap: int = 1) -> DataFrame:
    """Runs (img, r, lo, hi) of a row that overlap, or lie less than ``gap`` + 1 apart, as one."""
    w = Window.partitionBy("img", "r").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = runs.withColumn("_new", F.coalesce((F.col("lo") > before + gap).cast("int"), F.lit(1)))
    return own.withColumn("_n", F.sum("_new").over(w)).groupBy("img", "r", "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*RUN)


def ink_runs(px: DataFrame) -> DataFrame:
    """Runs of the pixels that are not above Otsu's threshold."""
    dark = raster.binarize(px).where("v = 0")
    return merged(dark.select("img", "r", F.col("c").alias("lo"), F.col("c").alias("hi")))


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def dilated(runs: DataFrame, size: DataFrame, wide: int, high: int, times: int) -> DataFrame:
    """Runs widened by a rectangle, so many times, within the image."""
    left, right, up, down = (times * n for n in (wide - 1 - wide // 2, wide // 2, high - 1 - high // 2, high // 2))
    spread = runs.join(size, "img").select("img", "h", F.explode(F.sequence(F.col("r") - up, F.col("r") + down)).alias("r"), F.greatest(F.lit(0), F.col("lo") - left).alias("lo"), F.least(F.col("w") - 1, F.col("hi") + right).alias("hi"))
    return merged(spread.where("r >= 0 and r < h"))


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by links (a, b): labels meet over links and jump to their own label, until nothing changes."""
    label = np.arange(n)
    while True:
        before, up = label.copy(), label[label]
        for x, y in ((a, b), (b, a)):
            np.minimum.at(label, label[x], up[y])
            np.minimum.at(label, x, up[y])
        label = label[label]
        if (label == before).all():
            return label


def touching(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): runs, ordered by row and place, of one row and of the next that share a column, or lie ``reach`` columns apart.

    ``row`` counts on from image to image, with a number left out between them.
    """
    wide = int(max(hi.max(initial=0), -lo.min(initial=0))) + reach + 2
    at = row * (2 * wide)
    first = np.searchsorted(at + hi, at + 2 * wide + lo - reach)
    last = np.searchsorted(at + lo, at + 2 * wide + hi + reach, side="right")
    n = np.maximum(0, last - first)
    return np.repeat(np.arange(len(row)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def outer_boxes(height: np.ndarray, width: np.ndarray, img: np.ndarray, r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(img, x, y, w, h) of each component of ink beside the free space around its image, not of those in another's hole.

    Free space has a border of one pixel around the image; it is linked by side, ink by corners too.
    """
    base = np.cumsum(height + 3) - (height + 3) + 1
    # in each row, the border too, the runs of ink and then a stop: each is preceded by what is free before it
    rows = np.repeat(np.arange(len(height)), height + 2)
    stops = np.arange(len(rows)) - np.repeat(np.cumsum(height + 2) - (height + 2), height + 2) - 1
    img, r = np.r_[img, rows], np.r_[r, stops]
    row = base[img] + r
    lo, hi = np.r_[lo, width[rows] + 1], np.r_[hi, width[rows] + 1]
    order = np.lexsort((lo, row))
    img, row, r, lo, hi = (x[order] for x in (img, row, r, lo, hi))
    ink, fresh = lo <= width[img], np.r_[True, row[1:] != row[:-1]][: len(row)]
    start = np.where(fresh, -1, np.r_[0, hi[:-1]][: len(row)] + 1)
    # all runs of a row in turn: free, ink, free
    free = np.c_[start < lo, np.zeros(len(lo), bool)].ravel()
    there = np.c_[start < lo, ink].ravel()
    img, row, r = (np.repeat(x, 2)[there] for x in (img, row, r))
    lo, hi, free = np.c_[start, lo].ravel()[there], np.c_[lo - 1, hi].ravel()[there], free[there]
    near, by_side = touching(row, lo, hi, 1), touching(row, lo, hi, 0)
    same = [(a[free[a] == free[b]], b[free[a] == free[b]]) for a, b in (near, by_side)]
    corner = ~free[same[0][0]]
    side = free[same[1][0]]
    label = connected(len(lo), np.r_[same[0][0][corner], same[1][0][side]], np.r_[same[0][1][corner], same[1][1][side]])
    outside = np.zeros(len(lo), bool)
    outside[label[free & (r == -1)]] = True
    outside = outside[label] & free
    # neighbours by side: above and below, left and right
    along = np.flatnonzero(row[1:] == row[:-1])
    a, b = np.r_[by_side[0], along], np.r_[by_side[1], along + 1]
    beside = np.zeros(len(lo), bool)
    beside[label[b[outside[a] & ~free[b]]]] = True
    beside[label[a[outside[b] & ~free[a]]]] = True
    own = np.flatnonzero(beside[label] & ~free)
    own = own[np.argsort(label[own], kind="stable")]
    if not len(own):
        return (own,) * 5
    at = np.flatnonzero(np.r_[True, label[own][1:] != label[own][:-1]])
    x, y = np.minimum.reduceat(lo[own], at), np.minimum.reduceat(r[own], at)
    return img[own][at], x, y, np.maximum.reduceat(hi[own], at) - x + 1, np.maximum.reduceat(r[own], at) - y + 1


def dealt(px: DataFrame) -> DataFrame:
    """Pixels of an image side by side, images dealt over all cores: small as they are, they would end up in few tasks."""
    spark = px.sparkSession
    return px.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "img")


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the arrays of a column hold PORTION items at most together, or are a single one."""
    for batch in batches:
        ends, lo = np.cumsum(batch.column(column).value_lengths().to_numpy().astype(np.int64)), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def boxes(runs: DataFrame, size: DataFrame) -> DataFrame:
    """(img, x, y, w, h) of outer components of runs (img, r, lo, hi); the runs of an image meet in its row."""
    rows = runs.groupBy("img").agg(F.collect_list(F.struct("r", "lo", "hi")).alias("runs")).join(size, "img").select("img", "h", "w", "runs")
    kind = rows.schema["img"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 3):
            height, width = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            flat = batch.column(3).flatten()
            of = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            img, *box = outer_boxes(height, width, of, *(flat.field(k).to_numpy().astype(np.int64) for k in range(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(img)), *(pa.array(x.astype(np.int32)) for x in box)], names=["img", "x", "y", "w", "h"])

    return rows.mapInArrow(find, f"img {kind}, x int, y int, w int, h int")


def text_regions(px: DataFrame, kernel: tuple[int, int] = (18, 4), times: int = 2, area: int = 1000, wide: int = 30, high: int = 8) -> DataFrame:
    """(img, x, y, w, h) of regions that may be text: outer components of dilated ink that are large enough.

    All three bounds must be passed.  An image without ink has none; an empty table gives none.
    """
    px = dealt(px.select("img", "r", "c", "v"))
    size = sizes(px)
    boxed = boxes(dilated(ink_runs(px), size, *kernel, times), size)
    return boxed.where(f"cast(w as bigint) * h > {area} and w > {wide} and h > {high}")


def largest(regions: DataFrame, most: int = 10) -> DataFrame:
    """The largest regions of each image by the area of their boxes, at most so many; ties from top to bottom."""
    w = Window.partitionBy("img").orderBy(F.desc(F.col("w") * F.col("h")), "y", "x")
    return regions.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < most)
