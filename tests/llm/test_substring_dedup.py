import random
import re

import numpy as np
import pytest

from tallyleaf.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def brute(rows, width):
    """Rows (doc_id, text), at most one text a doc_id but for equal rows."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: LAST if r[0] is None else r[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[doc_id] = (doc_id, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return sorted((out[i] for i, _ in rows), key=repr)


def check(spark, rows, width=20, parts=5):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, code int, part string").repartition(parts)
    got = S.remove_repeated(docs, width)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, width)


def corpus(seed, letters, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3))))
    passages = [" ".join(word() for _ in range(rng.choice((19, 20, 21, 40, 130, 600)))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(passages))
            elif kind < 0.5:
                w = rng.choice(passages).split(" ")
                w[rng.randrange(len(w))] = "edit"
                parts.append("\n".join(w))
            elif kind < 0.6 and texts:
                parts.append(rng.choice(texts) or "")
            elif kind < 0.65:
                parts.append(" ".join([word()] * rng.randrange(60)))
            elif kind < 0.7:
                parts.append(" ".join([word(), word(), word()] * rng.randrange(30)))
            else:
                parts.append(" \t".join(word() for _ in range(rng.randrange(80))))
        texts.append(" ".join(parts))
    texts[3], texts[4], texts[5] = None, "", " \n "
    return texts


@pytest.mark.parametrize("letters", ["ab", "abcdefgh語é"])
def test_equals_brute_force(spark, letters):
    rows = list(enumerate(corpus(len(letters), letters)))
    rows += [rows[7], rows[7], rows[8], (None, rows[9][1]), (None, rows[9][1]), (-5, rows[10][1])]
    check(spark, rows)


def test_smaller_windows(spark):
    check(spark, list(enumerate(corpus(5, "abc", 60))), width=7)


def test_group_of_copies_one_passage_in_all_and_a_long_text(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(70))
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))
    rows = [(k, f"start {k} of {k * 7} {passage} end {k % 5}") for k in range(600)] + [(k, long[: 4000]) for k in range(700, 900)]
    check(spark, [*rows, (1000, long), (1001, "tail " + long[1000:200_000])])


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeated(empty).count() == 0 and S.digest(empty).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    check(spark, [(1, None), (2, ""), (3, "a few words")])


def test_rows_of_one_doc_id(spark):
    shared = " ".join(f"s{k}" for k in range(30))
    docs = spark.createDataFrame([(1, shared + " one"), (1, shared + " two"), (1, shared + " two"), (2, shared)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in S.remove_repeated(docs).collect())
    # of two unlike texts of one doc_id one is first; its equal row, if any, gets the same result
    assert got in ([(1, 0), (1, 30), (1, 30), (2, 30)], [(1, 0), (1, 0), (1, 30), (2, 30)])


def test_ruled_out_windows_occur_once():
    """What a phrase depends on holds it wherever it stands."""
    rng = np.random.default_rng(1)
    w = rng.integers(0, 4, 4000, dtype=np.uint64)
    w[1000:1400] = w[300:700]
    a = S.stirred(w + np.uint64(1))
    [(_, p)] = [x for x in S.stages(a, a, np.zeros(len(w), dtype=np.int64), 10**9) if x[0] == 0]
    names = {}
    for k in range(len(p.a)):
        if 0 <= p.lo[k] and p.hi[k] <= len(w):
            names[(w[p.lo[k] : p.hi[k]].tobytes(), p.at[k] - p.lo[k])] = (p.a[k], p.n[k])
    at = {int(x): k for k, x in enumerate(p.at)}
    checked = 0
    for (text, shift), name in names.items():
        content = np.frombuffer(text, dtype=np.uint64)
        for s in range(len(w) - len(content) + 1):
            if w[s] == content[0] and (w[s : s + len(content)] == content).all():
                k = at[s + int(shift)]
                assert (p.a[k], p.n[k]) == name
                checked += 1
    assert checked > len(names) > 100
