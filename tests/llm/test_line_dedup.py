import random
import re
from collections import Counter, defaultdict

import pytest

from tallyleaf.llm import line_dedup as L


def brute(rows):
    index, sets, known, out = defaultdict(list), [], set(), []
    for i, t in sorted(rows):
        kept, gone = [], 0
        for line in t.split("\n"):
            w = [x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x]
            if not w:
                kept.append(line)
                continue
            s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            n = Counter(o for g in s for o in index[g])
            if s in known or any(100 * c >= 75 * (len(s) + len(sets[o]) - c) for o, c in n.items()):
                gone += 1
            else:
                kept.append(line)
            if s not in known:
                known.add(s)
                for g in s:
                    index[g].append(len(sets))
                sets.append(s)
        out.append((i, "\n".join(kept), gone))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    pool = [[word() for _ in range(rng.randrange(1, 40))] for _ in range(60)]

    def line():
        w = list(rng.choice(pool))
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = word()
        return rng.choice(["", " ", "\t"]) + " ".join(w)

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(0, 8)))) for k in range(80)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == brute(rows)


def test_joins_and_filters_are_dataframe_functions(spark):
    """Arrow code cuts and hashes words only: nothing is grouped or joined in Python."""
    from tallyleaf.llm.state import Scratch

    seen = []
    keep = Scratch.keep
    try:
        Scratch.keep = lambda self, df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df)
        L.dedup_lines(spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string")).collect()
    finally:
        Scratch.keep = keep
    assert seen and not any(re.search("FlatMapGroups|CoGroup|ArrowEvalPython|BatchEvalPython|AggregateInPandas", p) for p in seen)
    assert sum("MapInArrow" in p for p in seen) == 2


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(L, "LONG", 3)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    pool = [[word() for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    phrase = [word() for _ in range(12)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        return " ".join(w + phrase if rng.random() < 0.3 else w)

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(0, 8)))) for k in range(100)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == brute(rows)


def test_nulls_empty_long_and_clashes(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a b c", 1), (3, "a b c", 1), (4, "\n\n", 1), (5, "w " * 60_000, 1)]
    got = {r.doc_id: (r.text, r.n_removed_lines, r.token) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, token int")).collect()}
    assert got[1] == (None, 0, 1) and got[2][0] == "" and got[3][:2] == ("a b c", 0) and got[None][:2] == ("", 1) and got[4][0] == "\n\n"
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
