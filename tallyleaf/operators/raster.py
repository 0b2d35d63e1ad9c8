"""Raster operators: relational forms over pixel rows, and array forms for images.

A pixel table has (img, r, c, v) with integer v in 0..255.  The relational
forms reflect at the border without repeating the edge pixel, but for the
median, which repeats it, and morphology, which ignores what lies outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Pixels of a flat array of values in -1..1, row by row."""
    rows = df.select(F.col(key).alias("img"), F.posexplode(values).alias("i", "x"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("x").cast("double") + 1) * 127.5).cast("int")))
    return rows.select("img", F.expr(f"i div {width}").cast("int").alias("r"), (F.col("i") % width).cast("int").alias("c"), v.alias("v"))


def point(px: DataFrame, value: Column) -> DataFrame:
    return px.select("img", "r", "c", value.cast("int").alias("v"))


def invert(px: DataFrame) -> DataFrame:
    return point(px, 255 - F.col("v"))


def gamma(px: DataFrame, g: float = 0.6) -> DataFrame:
    return point(px, F.floor(F.least(F.lit(255.0), F.pow(F.col("v") / 255.0, F.lit(max(g, 0.01))) * 255)))


def stretch(px: DataFrame) -> DataFrame:
    ends = px.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.when(F.col("hi") == F.col("lo"), F.col("v")).otherwise(F.expr("((v - lo) * 255) div (hi - lo)"))
    return px.join(ends, "img").select("img", "r", "c", value.cast("int").alias("v"))


def histogram(px: DataFrame) -> DataFrame:
    """(img, v, n, below, upto, total): counts with running sums."""
    h = px.groupBy("img", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("img").orderBy("v")
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("img")))
    return h.withColumn("below", F.col("upto") - F.col("n"))


def equalize(px: DataFrame) -> DataFrame:
    h = histogram(px)
    low = h.groupBy("img").agg(F.min("upto").alias("first"))
    to = F.when(F.col("total") == F.col("first"), F.col("v")).otherwise(F.expr("((upto - first) * 510 + (total - first)) div (2 * (total - first))"))
    table = h.join(low, "img").select("img", "v", to.cast("int").alias("to"))
    return px.join(table, ["img", "v"]).select("img", "r", "c", F.col("to").alias("v"))


def otsu_threshold(px: DataFrame) -> DataFrame:
    """(img, t): the least threshold of the largest between-class variance; exact integers throughout."""
    w = Window.partitionBy("img").orderBy("v")
    h = histogram(px).withColumn("s", F.sum(F.col("v") * F.col("n")).over(w)).withColumn("all", F.sum(F.col("v") * F.col("n")).over(Window.partitionBy("img")))
    # n0 n1 (m0 - m1)^2 = (s0 n1 - s1 n0)^2 / (n0 n1), compared as a double
    n1 = F.col("total") - F.col("upto")
    gap = F.col("s") * n1 - (F.col("all") - F.col("s")) * F.col("upto")
    var = F.when(n1 > 0, gap.cast("double") * gap / (F.col("upto") * n1)).otherwise(-1.0)
    return h.withColumn("var", var).groupBy("img").agg(F.max(F.struct("var", (-F.col("v")).alias("neg"))).alias("b")).select("img", (-F.col("b.neg")).alias("t"))


def binarize(px: DataFrame) -> DataFrame:
    # pixels and thresholds meet by image: as rows of arrays pixels look small enough to be broadcast, which they aren't
    return px.join(otsu_threshold(px).hint("shuffle_hash"), "img").select("img", "r", "c", F.when(F.col("v") > F.col("t"), 255).otherwise(0).alias("v"))


def iterative_threshold(px: DataFrame, steps: int = 64, tolerance: float = 0.1) -> DataFrame:
    """(img, t): repeated mean of the class means, over a histogram array."""
    bins = px.groupBy("img", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n"))

    def mean(part: Column) -> Column:
        acc = F.aggregate(part, zero, lambda a, x: F.struct((a["s"] + x["v"] * x["n"]).alias("s"), (a["n"] + x["n"]).alias("n")))
        return F.when(acc["n"] > 0, acc["s"] / acc["n"])

    def step(a: Column, _: Column) -> Column:
        lo, hi = mean(F.filter("h", lambda x: x["v"] <= a["t"])), mean(F.filter("h", lambda x: x["v"] > a["t"]))
        new = F.coalesce((lo + hi) / 2, a["t"])
        return F.when(a["done"], a).otherwise(F.struct(new.alias("t"), (F.abs(new - a["t"]) <= tolerance).alias("done")))

    start = F.struct(mean(F.col("h")).alias("t"), F.lit(False).alias("done"))
    return bins.select("img", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["t"]).alias("t"))


def reflect(c: Column, size: int) -> Column:
    return F.when(c < 0, -c).when(c >= size, 2 * (size - 1) - c).otherwise(c)


def seen_from(px: DataFrame, along: str, size: int, reach: int, fix: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``px`` for each place along an axis that sees them at an offset d<along>; fixed places lie within reach."""
    steps = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(d).alias("d")) for e in range(-reach, reach + 1) for d in range(-reach, reach + 1)])
    rows = px.withColumn("_s", F.explode(steps)).withColumns({"_at": F.col(along) + F.col("_s.e"), f"d{along}": F.col("_s.d")})
    rows = rows.where(F.col("_at").between(0, size - 1) & (fix(F.col("_at") + F.col(f"d{along}")) == F.col(along)))
    return rows.withColumn(along, F.col("_at")).drop("_s", "_at")


def gathered(px: DataFrame, size: int, reach: int, values: list[Column], border: str = "reflect") -> DataFrame:
    """(img, r, c, n and the values): aggregates over dr, dc and v of each pixel and those around it.

    Pixels go to the places that see them, so nothing is joined: the size of a
    table of pixels is unknown to the planner, which took it for small and sent
    it through the driver.  n counts the rows of the place itself.
    """
    fix = {"reflect": lambda c: reflect(c, size), "repeat": lambda c: F.least(F.lit(size - 1), F.greatest(F.lit(0), c))}[border]
    at = seen_from(seen_from(px.select("img", "r", "c", "v"), "r", size, reach, fix), "c", size, reach, fix)
    own = F.count_if((F.col("dr") == 0) & (F.col("dc") == 0))
    return at.groupBy("img", "r", "c").agg(own.alias("n"), *values).where("n > 0")


def box_mean(px: DataFrame, size: int, reach: int = 1) -> DataFrame:
    k = (2 * reach + 1) ** 2
    return gathered(px, size, reach, [F.sum("v").alias("s")]).select("img", "r", "c", F.expr(f"(2 * s * n + {k}) div {2 * k}").cast("int").alias("v"))


def median(px: DataFrame, size: int, reach: int = 1) -> DataFrame:
    mid = ((2 * reach + 1) ** 2) // 2
    near = gathered(px, size, reach, [F.sort_array(F.collect_list("v")).alias("l")], "repeat")
    return near.select("img", "r", "c", F.get("l", F.expr(f"{mid} div n").cast("int")).alias("v"))


def sobel(px: DataFrame, size: int) -> DataFrame:
    """Sum of the absolute 3x3 gradients, halved and cut at 255."""
    weight = lambda a, b: F.expr(f"{a} * (2 - abs({b}))")
    s = gathered(px, size, 1, [F.sum(weight("dc", "dr") * F.col("v")).alias("gx"), F.sum(weight("dr", "dc") * F.col("v")).alias("gy")])
    return s.select("img", "r", "c", F.expr("least(255, (least(255, abs(gx * n)) + least(255, abs(gy * n))) div 2)").cast("int").alias("v"))


def laplacian(px: DataFrame, size: int) -> DataFrame:
    k = F.when((F.col("dr") == 0) & (F.col("dc") == 0), 5).when(F.abs("dr") + F.abs("dc") == 1, -1).otherwise(0)
    s = gathered(px, size, 1, [F.sum(k * F.col("v")).alias("s")])
    return s.select("img", "r", "c", F.greatest(F.lit(0), F.least(F.lit(255), F.col("s") * F.col("n"))).cast("int").alias("v"))


def extremes(px: DataFrame, reach: int, **aggs: Callable[[str], Column]) -> DataFrame:
    """(img, r, c, names): the least or greatest v in the square around each pixel, along rows and then along columns.

    Pixels go to the places within reach, also to those that the image lacks,
    so that rows with gaps lose nothing; such places are left out at the end.
    """
    step = F.explode(F.lit(list(range(-reach, reach + 1)))).alias("d")
    own = F.bool_or(F.col("own") & (F.col("d") == 0)).alias("own")
    at = px.select("img", "r", "c", *[F.col("v").alias(n) for n in aggs], F.lit(True).alias("own"))
    for along, other in (("c", "r"), ("r", "c")):
        moved = at.select("img", other, along, *aggs, "own", step).withColumn(along, F.col(along) + F.col("d"))
        at = moved.groupBy("img", "r", "c").agg(*[f(n).alias(n) for n, f in aggs.items()], own)
    return at.where("own").drop("own")


def morph(px: DataFrame, how: str, reach: int = 2) -> DataFrame:
    return extremes(px, reach, v=F.min if how == "erode" else F.max)


def morph_open(px: DataFrame, size: int, reach: int = 2) -> DataFrame:
    return morph(morph(binarize(px), "erode", reach), "dilate", reach)


def morph_close(px: DataFrame, size: int, reach: int = 2) -> DataFrame:
    return morph(morph(binarize(px), "dilate", reach), "erode", reach)


def morph_gradient(px: DataFrame, size: int, reach: int = 2) -> DataFrame:
    both = extremes(binarize(px), reach, hi=F.max, lo=F.min)
    return both.select("img", "r", "c", (F.col("hi") - F.col("lo")).alias("v"))


def gaussian_taps(size: int) -> list[float]:
    """Weights of a Gaussian of so many pixels, whose spread follows from the size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / math.fsum(w) for x in w]


def blurred_lines(px: DataFrame, line: str, along: str, value: str, size: int) -> DataFrame:
    """Pixels with ``value`` blurred along the rows or the columns; the edge pixel is repeated beyond the border.

    A line of an image is one array, so each value is a fold over its neighbours in place.
    """
    lines = px.groupBy("img", line).agg(F.array_sort(F.collect_list(F.struct(along, value, "v"))).alias("l"))
    taps = F.lit(gaussian_taps(size))
    at = lambda k: F.get("l", F.greatest(F.lit(0), F.least(F.size("l") - 1, k)))[value]
    fold = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda a, d: a + F.get(taps, d) * at(k + d - size // 2))
    made = F.transform("l", lambda x, k: F.struct(x[along].alias(along), x["v"].alias("v"), fold(k).alias(value)))
    return lines.select("img", line, F.inline_outer(made))


def adaptive_threshold(px: DataFrame, block: int = 35, less: int = 11) -> DataFrame:
    """White where a pixel is above its Gaussian mean less a constant; the mean is a whole number, halves to even.

    An even block grows by one, and one below 3 is 3.  Images may be of any size, rows of an image of one length.
    """
    size = max(3, block) + (max(3, block) + 1) % 2
    across = blurred_lines(px.withColumn("m", F.col("v").cast("double")), "r", "c", "m", size)
    both = blurred_lines(across, "c", "r", "m", size)
    mean = F.bround(F.col("m")).cast("int")
    return both.select("img", "r", "c", F.when(F.col("v") - mean > -less, 255).otherwise(0).alias("v"))


def clahe(px: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """Contrast evened out tile by tile; a pixel mixes what the four tiles around it make of its value.

    Counts above the limit are dealt out again: an equal share to each value,
    the rest one by one at even steps.  An image that tiles don't divide is
    continued by its mirror image, as is one that they divide one way only.
    A pixel goes to the tiles that count it and to the four that it asks; by
    tile and value they meet in one row, so that no tile's table of all values
    is made or joined.
    """
    image = Window.partitionBy("img")
    size = px.select("img", "r", "c", "v").withColumns({"h": F.max("r").over(image) + 1, "w": F.max("c").over(image) + 1})
    whole = (F.col("h") % tiles == 0) & (F.col("w") % tiles == 0)
    full = lambda n: F.when(whole, F.col(n)).otherwise(F.col(n) + tiles - F.col(n) % tiles)
    size = size.withColumns({"fh": full("h"), "fw": full("w")}).withColumns({"th": F.expr(f"fh div {tiles}").cast("int"), "tw": F.expr(f"fw div {tiles}").cast("int")})
    size = size.withColumns({"y": F.col("r") / F.col("th") - 0.5, "x": F.col("c") / F.col("tw") - 0.5})
    size = size.withColumns({"fy": F.col("y") - F.floor("y"), "fx": F.col("x") - F.floor("x")})
    again = lambda c, n, f: F.filter(F.array_distinct(F.array(F.col(c), 2 * (F.col(n) - 1) - F.col(c))), lambda x: (x == F.col(c)) | ((x >= F.col(n)) & (x < F.col(f))))
    role = lambda ti, tj, share: F.struct(ti.cast("int").alias("ti"), tj.cast("int").alias("tj"), share.alias("share"))
    counted = F.flatten(F.transform(again("r", "h", "fh"), lambda y: F.transform(again("c", "w", "fw"), lambda x: role(F.floor(y / F.col("th")), F.floor(x / F.col("tw")), F.lit(None).cast("double")))))
    within = lambda t: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), t))
    weight = lambda d, f: F.col(f) if d else 1 - F.col(f)
    asked = F.array(*[role(within(F.floor("y") + d), within(F.floor("x") + e), weight(d, "fy") * weight(e, "fx")) for d in (0, 1) for e in (0, 1)])
    rows = size.select("img", "r", "c", "v", "th", "tw", F.inline(F.concat(counted, asked)))
    met = rows.groupBy("img", "ti", "tj", "th", "tw", "v").agg(F.count_if(F.col("share").isNull()).alias("n"), F.collect_list(F.when(F.col("share").isNotNull(), F.struct("r", "c", "share"))).alias("parts"))
    tile = Window.partitionBy("img", "ti", "tj")
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("th") * F.col("tw") / 256)).cast("bigint")
    met = met.withColumn("limit", limit).withColumns({"over": F.sum(F.greatest(F.lit(0), F.col("n") - F.col("limit"))).over(tile), "all": F.sum("n").over(tile), "upto": F.sum(F.least("n", "limit")).over(tile.orderBy("v"))})
    upto = F.expr("upto + (v + 1) * (over div 256) + least(v div greatest(1, 256 div greatest(over % 256, 1)) + 1, over % 256)")
    to = F.least(F.lit(255), F.bround(upto * 255 / (F.col("th") * F.col("tw"))).cast("int"))
    # tiles beyond an image that is smaller than its mirror image have no pixels to count
    parts = met.where("all > 0").select("img", to.alias("to"), F.inline("parts"))
    mixed = parts.groupBy("img", "r", "c").agg(F.sum(F.col("share") * F.col("to")).alias("m"))
    # sums of four shares differ in their last bits by the order in which rows come
    return mixed.select("img", "r", "c", F.bround(F.round("m", 6)).cast("int").alias("v"))


# ---- array forms, for images of any size ----


def to_gray(a: np.ndarray) -> np.ndarray:
    """BGR to grey by weights of 1/16384; one channel passes."""
    if a.ndim == 2:
        return a
    x = a.astype(np.int64)
    return ((x[..., 0] * 1868 + x[..., 1] * 9617 + x[..., 2] * 4899 + 8192) >> 14).astype(np.uint8)


def convolve(a: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    kr, kc = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(a.astype(np.float64), ((kr, kr), (kc, kc)), mode=mode)
    w = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
    return np.einsum("ijkl,kl->ij", w, kernel)


def cut(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def odd(k: float, least: int = 3) -> int:
    k = max(least, int(k))
    return k if k % 2 else k + 1


def gaussian_kernel(k: int) -> np.ndarray:
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    x /= x.sum()
    return np.outer(x, x)


def otsu_level(g: np.ndarray) -> int:
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    n1 = n0[-1] - n0
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where((n0 > 0) & (n1 > 0), (s0 * n1 - (s0[-1] - s0) * n0) ** 2 / (n0 * n1), -1.0)
    return int(np.argmax(var))


def pick(a: np.ndarray, k: int, how: Callable, fill: str | int) -> np.ndarray:
    lo, hi = (k - 1) // 2, k // 2
    p = np.pad(a, ((lo, hi), (lo, hi)), mode="edge") if fill == "edge" else np.pad(a, ((lo, hi), (lo, hi)), constant_values=fill)
    return how(np.lib.stride_tricks.sliding_window_view(p, (k, k)), axis=(2, 3)).astype(np.uint8)


def binary(g: np.ndarray) -> np.ndarray:
    return np.where(g > otsu_level(g), 255, 0).astype(np.uint8)


def tiled(g: np.ndarray, clip_limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Equalisation in tiles with a cut histogram, blended between tiles."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    maps = np.zeros((tiles, tiles, 256))
    limit = max(1, int(clip_limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            maps[i, j] = np.clip(np.cumsum(np.minimum(n, limit) + over / 256) * 255 / (th * tw), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    i0, j0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - i0)[:, None], (x - j0)[None, :]
    at = lambda i, j: maps[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], g]
    return cut((1 - fy) * ((1 - fx) * at(i0, j0) + fx * at(i0, j0 + 1)) + fy * ((1 - fx) * at(i0 + 1, j0) + fx * at(i0 + 1, j0 + 1)))


LAPLACIAN = np.array([[0, -1, 0], [-1, 5, -1], [0, -1, 0]], dtype=np.float64)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=np.float64)


def _mean_level(g: np.ndarray, tolerance: float = 0.1) -> float:
    t = float(g.mean())
    while True:
        lo, hi = g[g <= t], g[g > t]
        new = t if not len(lo) or not len(hi) else (lo.mean() + hi.mean()) / 2
        if abs(new - t) <= tolerance:
            return new
        t = new


def _edges(g: np.ndarray, low: float = 60, high: float = 180) -> np.ndarray:
    """Gaussian, gradient, thin ridges, then weak edges that touch strong ones."""
    s = cut(convolve(g, gaussian_kernel(5)))
    gx, gy = convolve(s, SOBEL, "edge"), convolve(s, SOBEL.T, "edge")
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    ang = (np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    keep = np.zeros(m.shape, dtype=bool)
    for k, (dr, dc) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a = p[1 + dr : 1 + dr + m.shape[0], 1 + dc : 1 + dc + m.shape[1]]
        b = p[1 - dr : 1 - dr + m.shape[0], 1 - dc : 1 - dc + m.shape[1]]
        keep |= (ang == k) & (m > a) & (m >= b)
    weak, strong = keep & (m > low), keep & (m > high)
    while True:
        grown = weak & (pick(strong.astype(np.uint8), 3, np.max, 0) > 0)
        if (grown == strong).all():
            return np.where(strong, 255, 0).astype(np.uint8)
        strong = grown


def _gray(fn: Callable) -> Callable:
    return lambda a, **kw: fn(to_gray(a), **kw)


def _mean(a: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    k = odd(kernel_size)
    one = lambda x: cut(convolve(x, np.full((k, k), 1 / (k * k))))
    return one(a) if a.ndim == 2 else np.stack([one(a[..., c]) for c in range(a.shape[2])], axis=2)


def _stretch(g: np.ndarray) -> np.ndarray:
    lo, hi = int(g.min()), int(g.max())
    return g if lo == hi else ((g.astype(np.int64) - lo) * 255 // (hi - lo)).astype(np.uint8)


def _equalize(g: np.ndarray) -> np.ndarray:
    c = np.cumsum(np.bincount(g.ravel(), minlength=256))
    low = c[c > 0][0]
    return g if c[-1] == low else cut((c - low) * 255 / (c[-1] - low))[g]


def _adaptive(g: np.ndarray, block_size: int = 35, c_value: int = 11) -> np.ndarray:
    return np.where(g > cut(convolve(g, gaussian_kernel(odd(block_size)), "edge")).astype(int) - int(c_value), 255, 0).astype(np.uint8)


def _morph(order: str) -> Callable:
    def run(g: np.ndarray, kernel_size: int = 5) -> np.ndarray:
        k, b = max(3, int(kernel_size)), binary(g)
        erode, dilate = (lambda x: pick(x, k, np.min, 255)), (lambda x: pick(x, k, np.max, 0))
        return {"open": lambda: dilate(erode(b)), "close": lambda: erode(dilate(b)), "gradient": lambda: dilate(b) - erode(b)}[order]()

    return run


def _sobel(g: np.ndarray) -> np.ndarray:
    gx, gy = cut(np.abs(convolve(g, SOBEL))), cut(np.abs(convolve(g, SOBEL.T)))
    return cut((gx.astype(int) + gy) / 2)


def _auto(g: np.ndarray) -> np.ndarray:
    return binary(cut(convolve(tiled(pick(g, 3, np.median, "edge")), LAPLACIAN)))


def order_points(points: np.ndarray) -> np.ndarray:
    """Corners as top left, top right, bottom right, bottom left."""
    s, d = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def _components(mask: np.ndarray) -> np.ndarray:
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        most = np.max([p[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(mask, most, 0)
        if (new == label).all():
            return label
        label = new


def boxes(a: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, w, h of dark regions after a wide dilation: over 1000 px in area, 30 wide, 8 high."""
    g = to_gray(a)
    ink = 255 - binary(g)
    for _ in range(2):
        p = np.pad(ink, ((2, 1), (9, 8)))
        ink = np.lib.stride_tricks.sliding_window_view(p, (4, 18)).max(axis=(2, 3))
    label = _components(ink > 0)
    out = []
    for k in np.unique(label[label > 0]):
        r, c = np.nonzero(label == k)
        w, h = int(np.ptp(c)) + 1, int(np.ptp(r)) + 1
        if len(r) > 1000 and w > 30 and h > 8:
            out.append((int(c.min()), int(r.min()), w, h))
    return sorted(out, key=lambda b: (b[1], b[0]))


def _regions(a: np.ndarray) -> np.ndarray:
    out = np.stack([a] * 3, axis=2) if a.ndim == 2 else a.copy()
    for x, y, w, h in boxes(a):
        for sl in ((slice(y, y + h), x), (slice(y, y + h), x + w - 1), (y, slice(x, x + w)), (y + h - 1, slice(x, x + w))):
            out[sl] = (0, 255, 0)
    return out


def resample(a: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    r, c = np.clip(np.rint(rows).astype(int), 0, a.shape[0] - 1), np.clip(np.rint(cols).astype(int), 0, a.shape[1] - 1)
    return a[r, c]


def _deskew(a: np.ndarray) -> np.ndarray:
    """Rotation by the main axis of the ink; images with under ten dark pixels pass."""
    g = to_gray(a)
    r, c = np.nonzero(binary(g) == 0)
    if len(r) < 10:
        return a
    m = np.cov(np.stack([c, r]))
    angle = 0.5 * np.arctan2(2 * m[0, 1], m[0, 0] - m[1, 1])
    y, x = np.mgrid[: g.shape[0], : g.shape[1]]
    cy, cx = (g.shape[0] - 1) / 2, (g.shape[1] - 1) / 2
    return resample(a, cy + (x - cx) * np.sin(angle) + (y - cy) * np.cos(angle), cx + (x - cx) * np.cos(angle) - (y - cy) * np.sin(angle))


def warp(a: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrangle of four corners stretched to a rectangle."""
    q = order_points(np.asarray(corners, dtype=np.float64))
    w = int(max(np.hypot(*(q[1] - q[0])), np.hypot(*(q[2] - q[3]))))
    h = int(max(np.hypot(*(q[3] - q[0])), np.hypot(*(q[2] - q[1]))))
    dst = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=np.float64)
    rows = []
    for (x, y), (u, v) in zip(dst, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    p = np.append(np.linalg.solve(np.array(rows), q.ravel()), 1).reshape(3, 3)
    y, x = np.mgrid[:h, :w]
    z = p @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    return resample(a, (z[1] / z[2]).reshape(h, w), (z[0] / z[2]).reshape(h, w))


def _correct(a: np.ndarray) -> np.ndarray:
    """Warps the largest bright quadrangle; unchanged if there is none."""
    label = _components(binary(to_gray(a)) > 0)
    ids, n = np.unique(label[label > 0], return_counts=True)
    if not len(ids) or n.max() < 0.2 * label.size or n.max() > 0.98 * label.size:
        return a
    r, c = np.nonzero(label == ids[n.argmax()])
    q = order_points(np.stack([c, r], axis=1))
    return warp(a, q)


#: The operators by public key.
PROCESSORS: dict[str, Callable[..., np.ndarray]] = {
    "gray": to_gray,
    "invert": _gray(lambda g: 255 - g),
    "gamma": _gray(lambda g, gamma=0.6: np.clip((g.astype(np.float32) / 255) ** max(float(gamma), 0.01) * 255, 0, 255).astype(np.uint8)),
    "stretch": _gray(_stretch),
    "hist_equalize": _gray(_equalize),
    "mean": _mean,
    "denoise": _gray(lambda g, kernel_size=3: pick(g, odd(kernel_size), np.median, "edge")),
    "gaussian": _gray(lambda g, kernel_size=5: cut(convolve(g, gaussian_kernel(odd(kernel_size))))),
    "otsu": _gray(binary),
    "iter_threshold": _gray(lambda g, tolerance=0.1: np.where(g > _mean_level(g, float(tolerance)), 255, 0).astype(np.uint8)),
    "adaptive": _gray(_adaptive),
    "enhance": _gray(lambda g, clip_limit=2.0: tiled(g, float(clip_limit))),
    "edges": _gray(lambda g, low=60, high=180: _edges(g, float(low), float(high))),
    "sobel": _gray(_sobel),
    "laplacian": _gray(lambda g: cut(convolve(g, LAPLACIAN))),
    "morph_open": _gray(_morph("open")),
    "morph_close": _gray(_morph("close")),
    "morph_gradient": _gray(_morph("gradient")),
    "auto_optimize": _gray(_auto),
    "correct": _correct,
    "deskew": _deskew,
    "regions": _regions,
}


def process(df: DataFrame, methods: list[str], **params) -> DataFrame:
    """Images (height, width, n_channels, data) through a chain of operators in one task step.

    An image that an operator fails on comes back with its ``error`` and unchanged.
    """
    unknown = [m for m in methods if m not in PROCESSORS]
    if unknown:
        raise ValueError(f"unknown method: {unknown[0]}")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "error string"])

    def run(batches):
        import inspect

        for pdf in batches:
            for i in pdf.index:
                h, w, n = (int(pdf.at[i, c]) for c in ("height", "width", "n_channels"))
                a = np.frombuffer(pdf.at[i, "data"], dtype=np.uint8).reshape((h, w, n) if n > 1 else (h, w))
                error = None
                try:
                    for m in methods:
                        takes = inspect.signature(PROCESSORS[m]).parameters
                        loose = any(p.kind == p.VAR_KEYWORD for p in takes.values())
                        a = PROCESSORS[m](a, **{k: v for k, v in params.items() if k in takes or (loose and len(methods) == 1)})
                    pdf.at[i, "height"], pdf.at[i, "width"] = a.shape[:2]
                    pdf.at[i, "n_channels"] = a.shape[2] if a.ndim == 3 else 1
                    pdf.at[i, "data"] = np.ascontiguousarray(a).tobytes()
                except Exception as e:  # an error is data here: other images go on
                    error = f"{type(e).__name__}: {e}"
                pdf.at[i, "error"] = error
            if "error" not in pdf:
                pdf["error"] = None
            yield pdf

    return df.mapInPandas(run, schema)
