import numpy as np

from tallyleaf.operators import regions


def flood(mask, seeds, steps):
    """Places of the mask that the seeds reach."""
    todo, seen = list(seeds), set(seeds)
    while todo:
        r, c = todo.pop()
        for a, b in steps:
            p = (r + a, c + b)
            if p not in seen and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]:
                seen.add(p)
                todo.append(p)
    return seen


FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def brute(ink, area, wide, high):
    free = np.pad(~ink, 1, constant_values=True)
    outside = flood(free, [(0, 0)], FOUR)
    out, left = [], {tuple(p) for p in np.argwhere(ink)}
    while left:
        own = flood(ink, [next(iter(left))], EIGHT)
        left -= own
        r, c = zip(*own, strict=True)
        x, y, w, h = min(c), min(r), max(c) - min(c) + 1, max(r) - min(r) + 1
        beside = any((a + 1 + d, b + 1 + e) in outside for a, b in own for d, e in FOUR)
        if w * h > area and w > wide and h > high and beside:
            out.append((x, y, w, h))
    return sorted(out)


def image(kind, h=18, w=26):
    rng = np.random.default_rng(kind)
    if kind < 3:
        return rng.random((h, w)) < (0.25, 0.45, 0.6)[kind]
    a = np.zeros((h, w), dtype=bool)
    if kind == 3:  # a ring with a dot in its hole, in a larger ring
        a[1:17, 1:25], a[2:16, 2:24] = True, False
        a[4:12, 4:14], a[5:11, 5:13] = True, False
        a[7:9, 7:10] = True
    elif kind == 4:  # a long snake
        a[::2] = True
        a[1::4, -1], a[3::4, 0] = True, True
    return a


def pixels(spark, images):
    return spark.createDataFrame([(k, r, c, 10 if a[r, c] else 200) for k, a in enumerate(images) for r in range(a.shape[0]) for c in range(a.shape[1])], "img int, r int, c int, v int")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.img, []).append((r.x, r.y, r.w, r.h))
    return {k: sorted(v) for k, v in out.items()}


def test_boxes_of_outer_components(spark):
    images = [image(k) for k in range(5)]
    got = found(regions.text_regions(pixels(spark, images), kernel=(1, 1), times=1, area=0, wide=0, high=0))
    assert got == {k: brute(a, 0, 0, 0) for k, a in enumerate(images)}
    assert len(got[3]) == 1 and len(got[4]) == 1


def test_dilation_and_bounds(spark):
    a = np.zeros((40, 90), dtype=bool)
    a[10, 5], a[12, 30], a[30, 80:85] = True, True, True
    size = regions.sizes(pixels(spark, [a]))
    wide = np.zeros_like(a)
    for r, c in np.argwhere(a):
        wide[max(0, r - 2) : r + 5, max(0, c - 16) : c + 19] = True
    runs = regions.dilated(regions.ink_runs(pixels(spark, [a])), size, 18, 4, 2).collect()
    got = np.zeros_like(a)
    for r in runs:
        got[r.r, r.lo : r.hi + 1] = True
    assert (got == wide).all()
    assert found(regions.text_regions(pixels(spark, [a]), area=200, wide=30, high=6)) == {0: brute(wide, 200, 30, 6)}
    assert regions.text_regions(pixels(spark, [a]).limit(0)).count() == 0
    top = regions.largest(regions.text_regions(pixels(spark, [a]), area=0, wide=0, high=0), 1).collect()
    assert [(r.x, r.y, r.place) for r in top] == [(0, 8, 0)]
