"""Changes of view: corners put in order, homographies, images and boxes that follow them.

A homography is an array of nine numbers, row by row, the last one 1.  It comes
from an 8 by 8 system that is solved in place, so images and boxes by the
million need no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.operators import dataset, edges


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def order_points(points: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left; the first of equal ones."""

    def first(key: Callable[[Column], Column]) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct(key(p).alias("key"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    down, over = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    return F.array(first(down), first(over), first(lambda p: -down(p)), first(lambda p: -over(p)))


def solved(rows: Column, n: int) -> Column:
    """Solution of n equations (arrays of n + 1 numbers) by elimination with the largest pivot; nulls if there is none."""

    def step(a: Column, k: Column) -> Column:
        sizes = F.transform(a, lambda row, i: F.when(i >= k, F.struct(F.abs(F.get(row, k)).alias("size"), (-i).alias("i"))))

        def cleared(lead: Column, p: Column) -> Column:
            old = lambda i: F.get(a, F.when(i == p, k).otherwise(i))
            less = lambda row: F.transform(row, lambda x, j: x - F.get(row, k) * F.get(lead, j))
            return F.transform(a, lambda _, i: F.when(i == k, lead).otherwise(less(old(i))))

        def turned(p: Column) -> Column:
            lead = F.transform(F.get(a, p), lambda x: F.try_divide(x, F.get(F.get(a, p), k)))
            return let(lead, lambda found: cleared(found, p))

        return let(-F.array_max(sizes)["i"], turned)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))


def homography(source: Column, target: Column) -> Column:
    """The view that takes four points to four others; null if three of the points lie on a line."""
    rows = []
    for i in range(4):
        s, t = F.get(source, F.lit(i)), F.get(target, F.lit(i))
        x, y, one, zero = s["x"], s["y"], F.lit(1.0), F.lit(0.0)
        rows += [F.array(x, y, one, zero, zero, zero, -t["x"] * x, -t["x"] * y, t["x"]), F.array(zero, zero, zero, x, y, one, -t["y"] * x, -t["y"] * y, t["y"])]
    m = solved(F.array(*rows), 8)
    return let(m, lambda found: F.when(~F.exists(found, lambda v: v.isNull()), F.concat(found, F.array(F.lit(1.0)))))


def moved(m: Column, x: Column, y: Column) -> Column:
    """A point under a view; what goes to infinity goes to the origin."""
    at = lambda k: F.get(m, F.lit(k))
    row = lambda k: at(k) * x + at(k + 1) * y + at(k + 2)
    return let(F.coalesce(F.try_divide(F.lit(1.0), row(6)), F.lit(0.0)), lambda z: point(row(0) * z, row(3) * z))


def after(b: Column, a: Column) -> Column:
    """The view a, then b."""
    at = lambda m, i, j: F.get(m, F.lit(3 * i + j))
    both = lambda b, a: F.array(*[sum((at(b, i, k) * at(a, k, j) for k in (1, 2)), at(b, i, 0) * at(a, 0, j)) for i in range(3) for j in range(3)])
    return let(F.struct(b.alias("b"), a.alias("a")), lambda m: both(m["b"], m["a"]))


def inverse(m: Column) -> Column:
    """The view back, up to a factor."""
    at = lambda m, i, j: F.get(m, F.lit(3 * (i % 3) + j % 3))
    return let(m, lambda v: F.array(*[at(v, j + 1, i + 1) * at(v, j + 2, i + 2) - at(v, j + 1, i + 2) * at(v, j + 2, i + 1) for i in range(3) for j in range(3)]))


def warp(px: DataFrame, views: DataFrame, zero: bool = True) -> DataFrame:
    """Images of (img, h, w, back), where ``back`` takes a target's place to its source: linear mixes of four pixels.

    Beyond the border an image is black, or goes on with its edge.  Views
    without a matrix or an image give nothing.
    """
    rows = views.where("back is not null and h > 0 and w > 0").select("img", "w", "back", F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))).alias("r"))
    places = rows.select("img", "r", F.explode(F.sequence(F.lit(0), (F.col("w") - 1).cast("int"))).alias("c"), "back")
    places = places.join(px.select("img").distinct(), "img", "left_semi").withColumn("s", moved(F.col("back"), F.col("c").cast("double"), F.col("r").cast("double")))
    places = places.select("img", "r", "c", edges.at_32nds(F.col("s.x")).alias("sx"), edges.at_32nds(F.col("s.y")).alias("sy"))
    return edges.grey(edges.sampled(px, places, range(0, 2), edges.linear, zero), F.floor(F.col("m") + 0.5))


def rectified(px: DataFrame, quads: DataFrame) -> DataFrame:
    """The quadrangle of each image's four ``corners`` (any order) as an upright picture as large as its longer sides."""
    q = quads.select("img", order_points(F.col("corners")).alias("q"))
    at = lambda k: F.get("q", F.lit(k))
    long = lambda a, b: F.sqrt((at(a)["x"] - at(b)["x"]) * (at(a)["x"] - at(b)["x"]) + (at(a)["y"] - at(b)["y"]) * (at(a)["y"] - at(b)["y"]))
    q = q.withColumns({"w": F.greatest(long(2, 3), long(1, 0)).cast("int"), "h": F.greatest(long(1, 2), long(0, 3)).cast("int")})
    zero, right, low = F.lit(0), F.col("w") - 1, F.col("h") - 1
    upright = F.array(point(zero, zero), point(right, zero), point(right, low), point(zero, low))
    return warp(px, q.withColumn("back", homography(upright, F.col("q"))))


# ---- random views ----


def draw(seed: int, key: Column, k: int, low: float, high: float) -> Column:
    """A number between bounds that depends on seed, key and k alone."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(k))), 256), 1, 8), 16, 10).cast("double")
    return low + (high - low) * (head / 4294967296)


def random_view(key: Column, width: Column, height: Column, seed: int = 20260615) -> Column:
    """A slight change of view: corners move inward by up to 1.5 to 5.5 %, then a turn up to 2.5 degrees and a size of 0.965 to 1.035."""
    w, h = width.cast("double"), height.cast("double")
    dx, dy = w * draw(seed, key, 0, 0.015, 0.055), h * draw(seed, key, 1, 0.015, 0.055)
    own = lambda k: draw(seed, key, k, 0.0, 1.0)
    source = F.array(point(F.lit(0), F.lit(0)), point(w - 1, F.lit(0)), point(w - 1, h - 1), point(F.lit(0), h - 1))
    target = F.array(point(own(2) * dx, own(3) * dy), point(w - 1 - own(4) * dx, own(5) * dy), point(w - 1 - own(6) * dx, h - 1 - own(7) * dy), point(own(8) * dx, h - 1 - own(9) * dy))
    angle, size = F.radians(draw(seed, key, 10, -2.5, 2.5)), draw(seed, key, 11, 0.965, 1.035)
    a, b, cx, cy = size * F.cos(angle), size * F.sin(angle), w / 2, h / 2
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = F.array(a, b, (1 - a) * cx - b * cy, -b, a, b * cx + (1 - a) * cy, zero, zero, one)
    return after(turn, homography(source, target))


def moved_line(m: Column, class_id: Column, box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """The label line of the upright box around a moved box, cut to the image; null if a side is under two pixels."""
    x1, y1, x2, y2 = (c.cast("double") for c in box)
    four = F.transform(F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2)), lambda p: moved(m, p["x"], p["y"]))

    def line(q: Column) -> Column:
        xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
        return dataset.clipped_line(class_id, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width.cast("double"), height.cast("double"))

    return let(four, line)


def moved_lines(boxes: DataFrame, view: str, class_id: str, box: tuple[str, str, str, str], width: int, height: int) -> DataFrame:
    """Adds ``line``: the label line of the upright box around a moved box, cut to the image; null if a side is under two pixels.

    The moved corners are columns of their own, so each is worked out once and in compiled code.
    """
    at = lambda k: F.get(view, F.lit(k))
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in box)
    corners = ((x1, y1), (x2, y1), (x2, y2), (x1, y2))
    row = lambda k, x, y: at(k) * x + at(k + 1) * y + at(k + 2)
    # what goes to infinity goes to the origin
    out = boxes.withColumns({f"_z{i}": F.coalesce(F.try_divide(F.lit(1.0), row(6, x, y)), F.lit(0.0)) for i, (x, y) in enumerate(corners)})
    side = lambda k, pick: pick(*[row(k, x, y) * F.col(f"_z{i}") for i, (x, y) in enumerate(corners)])
    out = out.withColumns({"_left": side(0, F.least), "_top": side(3, F.least), "_right": side(0, F.greatest), "_low": side(3, F.greatest)})
    line = dataset.clipped_line(F.col(class_id), *(F.col(c) for c in ("_left", "_top", "_right", "_low")), F.lit(float(width)), F.lit(float(height)))
    return out.withColumn("line", line).drop(*[f"_z{i}" for i in range(4)], "_left", "_top", "_right", "_low")
