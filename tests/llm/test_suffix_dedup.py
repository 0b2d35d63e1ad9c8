import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyleaf.llm import suffix_dedup as S


def brute(rows):
    seen = Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    out = []
    for i, b in rows:
        cover = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = True
        runs = int((cover & ~np.append(False, cover[:-1])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~cover])
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(60) for _ in range(3)]
    docs = [para(80) + rng.choice(shared) + para(20) for _ in range(12)]
    docs += [docs[0], docs[0], docs[1][:300] + "X" + docs[1][301:], "ab" * 400, "a" * 199, "a" * 200, "a" * 201, shared[0] * 3, "", shared[1][:199]]
    return docs


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 2), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    """Also where anchors are dealt over several buckets."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.remove_repeats(df).collect()))
    assert got == brute([(i, t.encode()) for i, t in rows] + [(99, b"")])


@pytest.mark.parametrize("seed", range(5))
def test_two_stage_order(seed):
    rng = np.random.default_rng(seed)
    t = np.append(rng.integers(97, 97 + rng.integers(1, 5), 700), 255).astype(np.uint8)
    data = t.tobytes()
    sa = S.two_stage(t, S.block_ranks(t))
    assert sorted(sa.tolist()) == list(range(len(t)))
    order = [data[k : k + 200] for k in sa]
    assert order == sorted(order)


def test_empty_table_and_extra_columns(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.remove_repeats(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, sig string")).first().n_removed == 0


def test_a_byte_is_induced_at_once(monkeypatch):
    """Not each part of a byte's suffixes by itself."""
    t = np.append(np.random.default_rng(7).integers(40, 100, 30_000), 255).astype(np.uint8)
    rank, sort, calls = S.block_ranks(t), np.argsort, []
    monkeypatch.setattr(S.np, "argsort", lambda *a, **k: calls.append(len(a[0])) or sort(*a, **k))
    S.two_stage(t, rank)
    assert len(calls) < 500
