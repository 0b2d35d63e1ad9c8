import numpy as np
from pyspark.sql import functions as F

from tallyleaf.operators import edges, views

QUADS = [
    [(3, 2), (50, 6), (46, 41), (5, 35)],
    [(0, 0), (9, 0), (9, 9), (0, 9)],
    [(10, 1), (30, 12), (22, 33), (2, 20)],
]


def matrix(source, target):
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, dtype=float), np.array(target, dtype=float).ravel()), 1)


def test_homography_solves_the_system(spark):
    target = [(0, 0), (40, 0), (40, 30), (0, 30)]
    df = spark.createDataFrame([(k, q, target) for k, q in enumerate(QUADS)], "k int, q array<struct<x:int,y:int>>, t array<struct<x:int,y:int>>")
    pts = "array<struct<x:double,y:double>>"
    df = df.select("k", F.col("q").cast(pts).alias("q"), F.col("t").cast(pts).alias("t"))
    m = views.homography(F.col("q"), F.col("t"))
    for r in df.select("k", m.alias("m"), views.inverse(m).alias("back"), views.after(views.inverse(m), m).alias("one")).collect():
        want = matrix(QUADS[r.k], target)
        assert np.allclose(r.m, want)
        back = np.array(r.back).reshape(3, 3)
        assert np.allclose(back / back[2, 2], np.linalg.inv(want.reshape(3, 3)) / np.linalg.inv(want.reshape(3, 3))[2, 2])
        one = np.array(r.one).reshape(3, 3)
        assert np.allclose(one / one[0, 0], np.eye(3), atol=1e-9)
    flat = df.select(F.array(*[views.point(F.lit(k), F.lit(0)) for k in range(4)]).alias("q"), "t").select(views.homography(F.col("q"), F.col("t")).alias("m"))
    assert all(r.m is None for r in flat.collect())


def test_points_in_any_order(spark):
    rows = [(k, [q[i] for i in order]) for k, q in enumerate(QUADS) for order in ((0, 1, 2, 3), (2, 0, 3, 1), (3, 2, 1, 0))]
    df = spark.createDataFrame(rows, "k int, q array<struct<x:int,y:int>>").select("k", views.order_points(F.col("q")).alias("q"))
    for r in df.collect():
        assert [(p.x, p.y) for p in r.q] == QUADS[r.k]


def gradient(h=44, w=55):
    y, x = np.mgrid[:h, :w]
    return (x * 3 + y * 2).astype(int)


def table(spark, images):
    return spark.createDataFrame([(k, r, c, int(a[r, c])) for k, a in enumerate(images) for r in range(a.shape[0]) for c in range(a.shape[1])], "img int, r int, c int, v int")


def brute_warp(a, back, h, w, zero):
    out = np.zeros((h, w), dtype=int)
    at = lambda y, x: (a[y, x] if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] else 0) if zero else a[min(max(y, 0), a.shape[0] - 1), min(max(x, 0), a.shape[1] - 1)]
    for r in range(h):
        for c in range(w):
            x, y, z = back.reshape(3, 3) @ (c, r, 1)
            x, y = (np.floor(np.round(p / z * 32, 6) + 0.5) / 32 for p in (x, y))
            i, j = int(np.floor(y)), int(np.floor(x))
            m = sum((1 - abs(y - i - d)) * (1 - abs(x - j - e)) * at(i + d, j + e) for d in (0, 1) for e in (0, 1))
            out[r, c] = np.floor(m + 0.5)
    return out


def test_warp_equals_brute_force(spark):
    images = [gradient(), np.random.default_rng(3).integers(0, 256, (20, 31))]
    backs = [matrix([(0, 0), (30, 0), (30, 24), (0, 24)], q) for q in (QUADS[0], [(-4, -2), (35, 1), (33, 25), (2, 18)])]
    given = spark.createDataFrame([(k, 25, 31, [float(x) for x in m]) for k, m in enumerate(backs)] + [(7, 3, 3, None)], "img int, h int, w int, back array<double>")
    for zero in (True, False):
        rows = views.warp(table(spark, images), given, zero).collect()
        assert len(rows) == 2 * 25 * 31
        for k, m in enumerate(backs):
            got = np.full((25, 31), -1)
            for r in rows:
                if r.img == k:
                    got[r.r, r.c] = r.v
            assert (got == brute_warp(images[k], m, 25, 31, zero)).all()


def test_rectified_size_and_corners(spark):
    a = gradient()
    quads = spark.createDataFrame([(0, [(46.0, 41.0), (3.0, 2.0), (5.0, 35.0), (50.0, 6.0)])], "img int, corners array<struct<x:double,y:double>>")
    rows = {(r.r, r.c): r.v for r in views.rectified(table(spark, [a]), quads).collect()}
    h, w = max(r for r, _ in rows) + 1, max(c for _, c in rows) + 1
    assert (w, h) == (47, 35) and len(rows) == w * h
    assert [rows[p] for p in ((0, 0), (0, w - 1), (h - 1, w - 1), (h - 1, 0))] == [a[y, x] for x, y in QUADS[0]]


def test_random_views_are_slight_and_repeatable(spark):
    df = spark.range(300).select("id", views.random_view(F.col("id"), F.lit(400), F.lit(300)).alias("m"))
    got = {r.id: r.m for r in df.collect()}
    assert got == {r.id: r.m for r in df.repartition(5).collect()}
    assert len({tuple(m) for m in got.values()}) == 300
    far = []
    for m in got.values():
        for x, y in ((0, 0), (399, 0), (399, 299), (0, 299)):
            u, v, z = np.array(m).reshape(3, 3) @ (x, y, 1)
            far.append(np.hypot(u / z - x, v / z - y))
    assert 5 < np.mean(far) < 25 and max(far) < 60
    line = df.select(views.moved_line(F.col("m"), F.lit(3), tuple(F.lit(v) for v in (100, 80, 180, 120)), F.lit(400), F.lit(300)).alias("l")).collect()
    assert all(r.l.startswith("3 0.") for r in line)
    assert not df.select(views.moved_line(F.col("m"), F.lit(3), tuple(F.lit(v) for v in (900, 80, 980, 120)), F.lit(400), F.lit(300)).alias("l")).where("l is not null").count()


def test_empty_table(spark):
    none = table(spark, [])
    views_ = spark.createDataFrame([(0, 2, 2, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "img int, h int, w int, back array<double>")
    assert views.warp(none, views_).isEmpty() and edges.rotate(none, spark.createDataFrame([], "img int, angle double")).isEmpty()
