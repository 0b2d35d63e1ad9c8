import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyleaf.llm import ngram_join as N


def brute(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        n = Counter(o for g in s for o in index[g])
        for o, c in n.items():
            if 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                root[find(k)] = find(o)
        for g in s:
            index[g].append(k)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def texts(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    para = lambda n: [word() for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        return w

    base, shared = para(120), para(40)
    docs = [base] + [edited(base, rng.randrange(1, 6)) for _ in range(copies)]
    docs += [para(rng.randrange(20, 90)) + shared + para(rng.randrange(0, 30)) for _ in range(30)]
    docs += [shared + para(rng.randrange(1, 12)) for _ in range(30)]
    for _ in range(15):
        b = para(rng.randrange(4, 60))
        docs += [b, edited(b, 1), edited(b, 2), b]
    return [" ".join(d) for d in docs] + ["", "  ", "one two", "ONE  two", "one two three"]


@pytest.mark.parametrize(("seed", "copies", "long"), [(1, 20, 24), (2, 60, 24), (3, 60, 6), (4, 10, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, copies, long):
    monkeypatch.setattr(N, "LONG", long)
    rows = list(enumerate(texts(seed, copies)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, N.near_duplicates(df).collect())) == brute(rows)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, 0), (2, "a b c d e f", 0), (2, "a b c d e f", 0), (None, "a b c d e f", 0), (5, "x " * 50_000, 0)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, 2), (1, 0, 1), (2, 2, 2), (2, 2, 2), (5, 1, 5)]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    from tallyleaf.llm.state import Scratch, components

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components(links, Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def test_a_shingle_in_very_many_short_texts_of_a_chunk():
    batch = pa.RecordBatch.from_arrays([pa.array([f"this notice is in all {k}" for k in range(70_000)])], names=["text"])
    common = next(N.Shingler()(["this notice is in all"]))
    lone = next(N.Shingler()(["a text of its own"]))
    made = pa.Table.from_batches(N.keys_by_range(16)(iter([batch])))
    assert sum(len(k) // 2 for k in made.column("low").to_pylist()) == 140_000
    bits = {}
    for r in sorted(set(made.column("range").to_pylist())):
        own = N.measure_lists(16)(made.filter(pa.array([x == r for x in made.column("range").to_pylist()])))
        bits[r] = [np.frombuffer(own.column(c)[0].as_py(), dtype=np.uint8) for c in ("repeated", "long")]
    repeated, long = (np.concatenate([bits[r][k] for r in range(16)]) for k in (0, 1))
    assert N.held_by(repeated, common).all() and N.held_by(long, common).all() and not N.held_by(long, lone).any()
