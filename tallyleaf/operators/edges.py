"""Edges, skew and rotation of pixel tables (img, r, c, v).

Steps that look at neighbours go over the lines of an image as arrays, rows and
columns in turn, so each costs one shuffle and no row is copied.  Images may be
of any size, rows of an image of one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.operators import raster, regions

#: Weights of small Gaussian kernels by their size, in 1/256.
SMALL_GAUSSIANS = {1: (256,), 3: (64, 128, 64), 5: (16, 64, 96, 64, 16), 7: (8, 28, 56, 72, 56, 28, 8)}
#: Fixed value: the tangent of 22.5 degrees in 1/32768.
TAN_22 = 13573
#: Fixed value: the slope of the cubic kernel at one pixel.
CUBIC = -0.75


def lines(px: DataFrame, line: str, along: str, *values: str) -> DataFrame:
    """(img, line, l): each line of an image as one array in order."""
    return px.groupBy("img", line).agg(F.array_sort(F.collect_list(F.struct(along, *values))).alias("l"))


def put(df: DataFrame, along: str, made: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Every item of the lines anew, from itself and its place."""
    return df.withColumn("l", F.transform("l", lambda x, k: F.struct(x[along].alias(along), *[v.alias(n) for n, v in made(x, k).items()])))


def mirrored(k: Column) -> Column:
    """The item at a place that may lie beyond the ends, where the line goes on as its mirror image."""
    period = F.greatest(F.lit(1), 2 * (F.size("l") - 1))
    at = F.pmod(k, period)
    return F.get("l", F.least(at, period - at).cast("int"))


def repeated(k: Column) -> Column:
    return F.get("l", F.greatest(F.lit(0), F.least(F.size("l") - 1, k)))


def beyond(k: Column, name: str) -> Column:
    """The value at a place, zero outside."""
    return F.coalesce(F.get("l", F.when(k >= 0, k).otherwise(F.size("l")))[name], F.lit(0))


def smooth(df: DataFrame, along: str, value: str, size: int) -> DataFrame:
    """Lines with weighted sums of ``value``, in 1/256, for small sizes."""
    weights = SMALL_GAUSSIANS[size]
    total = lambda k: sum((w * mirrored(k + d - size // 2)[value] for d, w in enumerate(weights)), F.lit(0))
    return put(df, along, lambda x, k: {value: total(k).cast("int")})


def blurred_columns(px: DataFrame, size: int) -> DataFrame:
    across = smooth(lines(px, "r", "c", "v"), "c", "v", size).select("img", "r", F.inline("l"))
    down = smooth(lines(across, "c", "r", "v"), "r", "v", size)
    return put(down, "r", lambda x, k: {"v": F.shiftright(x["v"] + (1 << 15), 16)})


def gaussian(px: DataFrame, size: int = 5) -> DataFrame:
    """Gaussian blur by whole-number weights; even sizes grow by one, sizes are 3 to 7.  Half a grey goes up."""
    size = max(3, size) + (max(3, size) + 1) % 2
    if size not in SMALL_GAUSSIANS:
        raise ValueError(f"no whole-number weights for size {size}")
    return blurred_columns(px, size).select("img", "c", F.inline("l")).select("img", "r", "c", "v")


class Along:
    """Lines of pixels in order, many at once: the items before and behind each item of its line."""

    def __init__(self, *keys: np.ndarray):
        fresh = np.ones(len(keys[0]), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        start = np.flatnonzero(fresh)
        n = np.diff(np.r_[start, len(fresh)])
        self.start, self.n = np.repeat(start, n), np.repeat(n, n)
        self.k = np.arange(len(fresh)) - self.start

    def mirrored(self, v: np.ndarray, d: int) -> np.ndarray:
        period = np.maximum(1, 2 * (self.n - 1))
        at = (self.k + d) % period
        return v[self.start + np.minimum(at, period - at)]

    def repeated(self, v: np.ndarray, d: int) -> np.ndarray:
        return v[self.start + np.clip(self.k + d, 0, self.n - 1)]

    def beyond(self, v: np.ndarray, d: int) -> np.ndarray:
        """The value there, zero outside."""
        at = self.k + d
        return np.where((at >= 0) & (at < self.n), self.repeated(v, d), 0)


def ridges(img: np.ndarray, r: np.ndarray, c: np.ndarray, v: np.ndarray, low: int, high: int) -> np.ndarray:
    """For pixels in order of rows: 1 where the gradient is over ``low`` and largest across the edge, 2 if it is over ``high`` too, else 0.

    Lengths of gradients are sums of absolute values.  Along a row or column the
    first of two equal ones is the ridge, on diagonals neither is.
    """
    turned = np.lexsort((r, c, img))
    back = np.empty_like(turned)
    back[turned] = np.arange(len(turned))
    rows, columns = Along(img, r), Along(img[turned], c[turned])
    taps = [(d - 2, w) for d, w in enumerate(SMALL_GAUSSIANS[5])]
    v = sum(w * rows.mirrored(v, d) for d, w in taps)[turned]
    v = sum(w * columns.mirrored(v, d) for d, w in taps) + (1 << 15) >> 16
    up, down = columns.repeated(v, -1), columns.repeated(v, 1)
    s, d = (up + 2 * v + down)[back], (down - up)[back]
    gx, gy = rows.repeated(s, 1) - rows.repeated(s, -1), rows.repeated(d, -1) + 2 * d + rows.repeated(d, 1)
    m = np.abs(gx) + np.abs(gy)
    left, right = rows.beyond(m, -1)[turned], rows.beyond(m, 1)[turned]
    gx, gy, m = gx[turned], gy[turned], m[turned]
    wide, high_ = np.abs(gx), np.abs(gy) * 32768
    rising = (gx < 0) != (gy < 0)
    before = np.where(rising, columns.beyond(right, -1), columns.beyond(left, -1))
    after = np.where(rising, columns.beyond(left, 1), columns.beyond(right, 1))
    flat = (m > left) & (m >= right)
    steep = (m > columns.beyond(m, -1)) & (m >= columns.beyond(m, 1))
    ridge = np.where(high_ < wide * TAN_22, flat, np.where(high_ > wide * (TAN_22 + 65536), steep, (m > before) & (m > after)))
    low, high = min(low, high), max(low, high)
    return np.where(ridge & (m > low), np.where(m > high, 2, 1), 0)[back]


def linked(img: np.ndarray, r: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which pixels, in order of rows, are ridges (1, strong ones 2) that neighbours lead to a strong one."""
    thin = np.flatnonzero(e)
    img, r, c, strong = img[thin], r[thin], c[thin], e[thin] == 2
    # rows count on from image to image, with one left out between them
    fresh = np.r_[True, img[1:] != img[:-1]][: len(img)]
    last = np.r_[0, r[:-1]][: len(r)]
    row = r + np.cumsum(np.where(fresh, last + 2, 0))
    beside = np.flatnonzero((row[1:] == row[:-1]) & (c[1:] - c[:-1] <= 1))
    a, b = regions.touching(row, c, c, 1)
    label = regions.connected(len(row), np.r_[a, beside], np.r_[b, beside + 1])
    sure = np.zeros(len(row), bool)
    sure[label[strong]] = True
    out = np.zeros(len(e), bool)
    out[thin] = sure[label]
    return out


def edges(px: DataFrame, low: int = 60, high: int = 180) -> DataFrame:
    """255 on edges: ridges of the blurred image that are strong or linked with strong ones; 0 elsewhere.

    The pixels of an image meet in its row; some hundred thousand are looked at
    at once, a larger image by itself.  Flat images have no edge, an empty table
    gives none.
    """
    whole = regions.dealt(px.select("img", "r", "c", "v")).groupBy("img").agg(F.collect_list(F.struct("r", "c", "v")).alias("l"))
    kind = whole.schema["img"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regions.portions(batches, 1):
            flat, n = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy()
            img = np.repeat(np.arange(len(n)), n)
            r, c, v = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            order = np.lexsort((c, r, img))
            r, c, v = r[order], c[order], v[order]
            # as by joins, there is no edge in an image without a name
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            e = linked(img, r, c, ridges(img, r, c, v, low, high)) & named[img]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(img)), *(pa.array(x.astype(np.int32)) for x in (r, c, np.where(e, 255, 0)))], names=["img", "r", "c", "v"])

    return whole.mapInArrow(find, f"img {kind}, r int, c int, v int")


# ---- skew ----


def turn(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies to the side of greater ``c`` of the line from a to b, for growing ``r``."""
    return (b["r"] - a["r"]) * (p["c"] - a["c"]) - (b["c"] - a["c"]) * (p["r"] - a["r"])


def chain(points: Column, sign: int) -> Column:
    """Convex chain of points of growing ``r``: that of least ``c`` for sign 1, of greatest for -1.

    A new point hides the last ones of the chain: those at which it doesn't turn
    outwards, and such a one is never followed by one that stays.
    """

    def add(stack: Column, p: Column) -> Column:
        seen = F.filter(stack, lambda x, i: (i == 0) | (sign * turn(F.get(stack, F.greatest(F.lit(0), i - 1)), x, p) > 0))
        return F.concat(seen, F.array(p))

    return F.aggregate(F.slice(points, F.lit(2), F.greatest(F.lit(0), F.size(points) - 1)), F.slice(points, F.lit(1), F.lit(1)), add)


def skew(px: DataFrame, least: int = 10) -> DataFrame:
    """(img, points, angle): dark pixels by Otsu, and the angle in degrees that levels the smallest rectangle around them.

    The rectangle has a side on the convex hull.  Only the ends of rows can be
    on it, so an image is an array of two points a row.  Angles are over -45 up
    to 45, 0 where there are fewer than ``least`` dark pixels; of equally small
    rectangles the one that is turned least counts, then that of smaller angle.
    """
    dark = raster.binarize(px).where("v = 0")
    rows = dark.groupBy("img", "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
    point = lambda c: F.struct(F.col("r").cast("bigint").alias("r"), F.col(c).cast("bigint").alias("c"))
    found = rows.groupBy("img").agg(F.sum("n").alias("points"), F.array_sort(F.collect_list(point("lo"))).alias("lo"), F.array_sort(F.collect_list(point("hi"))).alias("hi"))
    found = found.where(F.col("points") >= least).select("img", "points", chain(F.col("lo"), 1).alias("lo"), chain(F.col("hi"), -1).alias("hi"))
    # around the hull: down one chain and up the other; steps of no length are no sides
    found = found.withColumn("hull", F.concat("lo", F.reverse("hi")))
    step = lambda a, b: F.struct((b["r"] - a["r"]).alias("r"), (b["c"] - a["c"]).alias("c"))
    sides = F.filter(F.transform("hull", lambda p, i: step(p, F.get("hull", F.pmod(i + 1, F.size("hull"))))), lambda d: (d["r"] != 0) | (d["c"] != 0))
    found = found.withColumn("sides", F.array_distinct(sides))

    def spread(value: Callable[[Column], Column]) -> Column:
        all_ = F.transform("hull", value)
        return F.array_max(all_) - F.array_min(all_)

    def rectangle(d: Column) -> Column:
        along, across = spread(lambda p: p["r"] * d["r"] + p["c"] * d["c"]), spread(lambda p: p["r"] * d["c"] - p["c"] * d["r"])
        u, w = d["r"], -d["c"]
        slope = F.when(F.abs(u) > F.abs(w), w / u).when(F.abs(u) < F.abs(w), -u / w).otherwise(1.0)
        area = along.cast("double") * across / (d["r"] * d["r"] + d["c"] * d["c"])
        return F.struct(area.alias("area"), F.abs(slope).alias("off"), slope.alias("slope"))

    best = F.array_min(F.transform("sides", rectangle))["slope"]
    angles = found.select("img", "points", (F.round(F.degrees(F.atan(best)), 9) + 0.0).alias("angle"))
    every = px.select("img").distinct().join(rows.groupBy("img").agg(F.sum("n").alias("points")), "img", "left")
    return every.join(angles.select("img", "angle"), "img", "left").select("img", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("angle", F.lit(0.0)).alias("angle"))


def cubic(far: Column) -> Column:
    """Weight of a pixel at a distance below 2."""
    t = F.abs(far)
    near = ((CUBIC + 2) * t - (CUBIC + 3)) * t * t + 1
    return F.when(t <= 1, near).when(t < 2, ((CUBIC * t - 5 * CUBIC) * t + 8 * CUBIC) * t - 4 * CUBIC).otherwise(0.0)


def linear(far: Column) -> Column:
    """Weight of a pixel at a distance up to 1."""
    return F.greatest(F.lit(0.0), 1 - F.abs(far))


def at_32nds(place: Column) -> Column:
    """Places as whole 1/32 pixels, halves up; far ones are cut off well outside of any image."""
    return F.floor(F.round(F.greatest(F.lit(-1e7), F.least(F.lit(1e7), place)) * 32, 6) + 0.5) / 32


def sampled(px: DataFrame, places: DataFrame, taps: range, weight: Callable[[Column], Column], zero: bool) -> DataFrame:
    """(img, r, c, m): weighted sums of the pixels around (sx, sy) of places (img, r, c, sx, sy).

    Beyond its border an image is zero, or goes on with its edge.  A target
    pixel meets each row it needs as an array, not its pixels one by one.
    """
    rows = F.transform(F.sequence(F.lit(taps[0]), F.lit(taps[-1])), lambda d: F.floor("sy") + d)
    some = places.select("*", F.explode(rows).alias("at"))
    if zero:
        some = some.withColumn("row", F.col("at").cast("int"))
    else:
        some = some.join(px.groupBy("img").agg(F.max("r").alias("last")), "img").withColumn("row", F.greatest(F.lit(0), F.least(F.col("last"), F.col("at"))).cast("int"))
    source = lines(px, "r", "c", "v").withColumnRenamed("r", "row")
    place = lambda d: (F.floor("sx") + d).cast("int")
    pixel = lambda d: beyond(place(d), "v") if zero else repeated(place(d))["v"]
    values = [weight(F.col("sx") - F.floor("sx") - d) * pixel(d) for d in taps]
    part = weight(F.col("sy") - F.col("at")) * sum(values[1:], values[0])
    mixed = some.join(source, ["img", "row"], "left").groupBy("img", "r", "c").agg(F.sum(F.when(F.col("l").isNull(), 0.0).otherwise(part)).alias("m"))
    # sums differ in their last bits by the order in which rows come
    return mixed.withColumn("m", F.round("m", 6))


def grey(px: DataFrame, m: Column) -> DataFrame:
    return px.select("img", "r", "c", F.greatest(F.lit(0), F.least(F.lit(255), m)).cast("int").alias("v"))


def rotate(px: DataFrame, angles: DataFrame) -> DataFrame:
    """Images turned by (img, angle) about their middle, anticlockwise, of the same size.

    Values are cubic mixes of four by four pixels; the edge goes on beyond the border.
    """
    size = px.groupBy("img").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).join(angles.select("img", F.radians("angle").alias("a")), "img")
    places = px.select("img", "r", "c").join(size, "img").withColumns({"x": F.col("c") - F.expr("w div 2"), "y": F.col("r") - F.expr("h div 2")})
    sx = F.cos("a") * F.col("x") - F.sin("a") * F.col("y") + F.expr("w div 2")
    sy = F.sin("a") * F.col("x") + F.cos("a") * F.col("y") + F.expr("h div 2")
    places = places.select("img", "r", "c", at_32nds(sx).alias("sx"), at_32nds(sy).alias("sy"))
    return grey(sampled(px, places, range(-1, 3), cubic, zero=False), F.bround("m"))


def deskew(px: DataFrame) -> DataFrame:
    """Images turned so that the smallest rectangle around their ink stands level; nothing to level, nothing turned."""
    return rotate(px, skew(px))
