import hashlib
import math
import re
import zlib
from collections import Counter

from tallyleaf.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(I.CAPITALS, I.SMALL)


def grams(text, orders):
    w = WORD.findall((text or "").translate(FOLD))
    return [" ".join(w[k : k + n]) for n in range(1, orders + 1) for k in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent, least, orders, buckets, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, orders)[0]) for texts in ([d[1] for d in docs], target))
    total, want = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (want + buckets))))
    out = []
    for doc_id, text in docs:
        g, n = grams(text, orders)
        weight = sum(gain(bucket(x)) for x in g)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus():
    word = lambda k: ["alpha", "Beta", "naïve", "語語", "x9", "zeta", "ETA", "it's", "a-b"][k % 9] + ("" if k % 4 else str(k % 7))
    docs = [(k, " ".join(word(k * j + j * j % 11) for j in range(k % 50)) + (".\n" if k % 3 else "")) for k in range(300)]
    docs += [(301, None), (302, ""), (303, "!!! ---"), (None, "alpha beta " * 15), (None, None), (304, "Alpha,beta;ALPHA" * 20_000)]
    docs += [(k, "the same text " * 10) for k in range(400, 500)] + [(500, "twin row " * 12)] * 2
    return docs


def check(spark, **how):
    docs, target = corpus(), ["alpha beta x9 x9", None, "naïve 語語 eta", ""]
    how = {"percent": 10, "least": 20, "orders": 1, "buckets": 97, "seed": 2024} | how
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, weight int, bucket string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(df, goal, how["percent"], how["least"], how["orders"], how["buckets"], how["seed"])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, **how)


def test_words(spark):
    check(spark)


def test_runs_of_three_words(spark):
    check(spark, orders=3, percent=35, least=2)


def test_all_are_drawn(spark):
    check(spark, percent=100, least=0, buckets=10_000, seed=7)


def test_none_is_drawn(spark):
    check(spark, percent=0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    goal = spark.createDataFrame([("one word",)], "text string")
    assert I.resample(empty, goal).count() == 0
    few = spark.createDataFrame([(1, "one " * 30), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in I.resample(few, goal.limit(0), percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[2].weight == 0
