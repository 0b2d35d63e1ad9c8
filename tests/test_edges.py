import numpy as np
import pytest

from tallyleaf.operators import edges


def table(spark, images):
    rows = [(k, r, c, int(a[r, c])) for k, a in enumerate(images) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "img int, r int, c int, v int")


def images(df, like):
    out = [np.full(a.shape, -1) for a in like]
    for x in df.collect():
        out[x.img][x.r, x.c] = x.v
    return out


def scene(kind, h=17, w=29):
    rng = np.random.default_rng(kind)
    if kind == 0:
        return rng.integers(0, 256, (h, w))
    if kind == 1:  # a square on grey with soft noise
        a = rng.integers(90, 110, (h, w))
        a[4:13, 6:20] = 200
        return a
    if kind == 2:
        return np.full((h, w), 77)
    if kind == 3:  # a ramp that is weak but for its end
        return np.tile(np.minimum(255, np.arange(w) * 6 + (np.arange(w) > 20) * 90), (h, 1))
    return rng.integers(0, 256, (1, 5))


def blurred(a):
    w = np.array([1, 4, 6, 4, 1])
    index = lambda n: [min(k % max(1, 2 * n - 2), max(1, 2 * n - 2) - k % max(1, 2 * n - 2)) if n > 1 else 0 for k in range(-2, n + 2)]
    p = a[np.ix_(index(a.shape[0]), index(a.shape[1]))]
    s = sum(w[i] * w[j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5))
    return (s + 128) // 256


def brute_edges(a, low=60, high=180):
    h, w = a.shape
    p = np.pad(blurred(a), 1, mode="edge").astype(int)
    at = lambda r, c: p[1 + r : 1 + r + h, 1 + c : 1 + c + w]
    gx = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    m = np.pad(np.abs(gx) + np.abs(gy), 1)
    thin, strong = set(), []
    for r in range(h):
        for c in range(w):
            x, y, n = abs(gx[r, c]), abs(gy[r, c]) * 32768, m[r + 1, c + 1]
            if n <= low:
                continue
            if y < x * 13573:
                ok = n > m[r + 1, c] and n >= m[r + 1, c + 2]
            elif y > x * (13573 + 65536):
                ok = n > m[r, c + 1] and n >= m[r + 2, c + 1]
            else:
                s = -1 if (gx[r, c] < 0) != (gy[r, c] < 0) else 1
                ok = n > m[r, c + 1 - s] and n > m[r + 2, c + 1 + s]
            if ok:
                thin.add((r, c))
                strong += [(r, c)] if n > high else []
    seen, todo = set(strong), list(strong)
    while todo:
        r, c = todo.pop()
        for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if q in thin and q not in seen:
                seen.add(q)
                todo.append(q)
    out = np.zeros((h, w), dtype=int)
    for q in seen:
        out[q] = 255
    return out


def test_edges_equal_brute_force(spark):
    all_ = [scene(k) for k in range(5)]
    got = images(edges.edges(table(spark, all_)), all_)
    want = [brute_edges(a) for a in all_]
    assert all((g == w).all() for g, w in zip(got, want, strict=True))
    assert want[1].any() and want[3].any() and not want[2].any()


def test_gaussian_equals_brute_force(spark):
    all_ = [scene(k) for k in range(5)]
    got = images(edges.gaussian(table(spark, all_), 4), all_)
    assert all((g == blurred(a)).all() for g, a in zip(got, all_, strict=True))
    with pytest.raises(ValueError):
        edges.gaussian(table(spark, all_), 9)


def bar(angle, h=61, w=71, long=24, short=7):
    """A dark bar on white whose long side rises by so many degrees to the right."""
    y, x = np.mgrid[:h, :w]
    t = np.radians(angle)
    u = (x - w // 2) * np.cos(t) - (y - h // 2) * np.sin(t)
    v = (x - w // 2) * np.sin(t) + (y - h // 2) * np.cos(t)
    return np.where((np.abs(u) <= long) & (np.abs(v) <= short), 20, 230)


def test_skew_is_found_and_levelled(spark):
    tilts = [0, 7, -13, 30, -40]
    few = np.full((6, 6), 200)
    few[1, 1:4] = 10
    all_ = [bar(t) for t in tilts] + [few, np.full((4, 4), 9)]
    px = table(spark, all_)
    found = {r.img: (r.points, r.angle) for r in edges.skew(px).collect()}
    for k, t in enumerate(tilts):
        assert abs(found[k][1] + t) < 2.5, (t, found[k])
    assert found[5] == (3, 0.0)
    turned = images(edges.deskew(px), all_)
    level = {r.img: r.angle for r in edges.skew(table(spark, turned[:5])).collect()}
    assert all(abs(a) < 2.5 for a in level.values())
    assert (turned[5] == few).all() and (turned[0] == all_[0]).all()


def test_skew_equals_rectangles_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    all_ = [np.where(rng.random((7, 9)) < 0.3, 10, 240) for _ in range(12)]
    found = {r.img: r.angle for r in edges.skew(table(spark, all_)).collect()}
    for k, a in enumerate(all_):
        p = np.argwhere(a == 10)
        best = []
        for i in range(len(p)):
            for j in range(len(p)):
                d = p[j] - p[i]
                side = (p - p[i]) @ np.array([-d[1], d[0]])
                if d.any() and (side >= 0).all():
                    t, n = p @ d, p @ np.array([d[1], -d[0]])
                    turn = -np.degrees(np.arctan2(d[1], d[0]))
                    turn = 45 - (45 - turn) % 90
                    best.append((round(float(np.ptp(t)) * float(np.ptp(n)) / float(d @ d), 9), round(abs(turn), 9), round(turn, 9)))
        assert abs(min(best)[2] - found[k]) < 1e-6 or len(p) < 10


def test_empty_table(spark):
    none = table(spark, [])
    assert edges.edges(none).isEmpty() and edges.deskew(none).isEmpty() and edges.skew(none).isEmpty()
