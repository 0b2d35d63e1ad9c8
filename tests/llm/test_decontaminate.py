import random

import pytest

from tallyleaf.llm import decontaminate as D


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(2))
    return rng, lambda n: " ".join(word() for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_wand_equals_scoring_all(seed):
    rng, para = corpus(seed)
    index = D.Index([(k, para(rng.randrange(3, 30)) + ". " + para(5)) for k in range(200)])
    terms = list(index.postings)
    for threshold in (0.05, 0.2, 0.5):
        for _ in range(40):
            query = rng.sample(terms, min(len(terms), rng.randrange(1, 60)))
            want = {}
            for t in query:
                ids, impacts, _, _ = index.postings[t]
                for k, x in zip(ids, impacts, strict=True):
                    want[k] = want.get(k, 0) + x
            want = {k for k, x in want.items() if x >= threshold - 1e-9}
            assert {k for k, _ in index.retrieve(query, threshold)} == want


def test_leaks_are_found_and_clean_texts_left(spark):
    rng, _ = corpus(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    para = lambda n: " ".join(word() for _ in range(n))
    items = [(k, para(20) + ". " + para(8) + "." if k % 2 else para(25)) for k in range(30)] + [(99, "two words"), (100, None)]
    docs = [(k, para(200)) for k in range(40)]
    docs += [(100 + k, para(rng.randrange(0, 300)) + "\n" + items[k][1].upper() + " " + para(rng.randrange(0, 90))) for k in range(30)]
    docs += [(200, items[0][1]), (201, None), (202, ""), (203, " ".join(items[1][1].split()[:8]) + " " + para(40)), (None, para(50))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect()}
    assert got == {(100 + k, k) for k in range(30)} | {(200, 0)}
    assert {r.doc_id for r in D.remove_leaking(df, bench).collect()} == {*range(40), 201, 202, 203, None}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(5)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "text", "'x' as item_id")
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()) == [(k, k) for k in range(5)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, items).count() == 0 and D.find_leaks(docs.limit(0), items).count() == 0


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    items = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}") for k in range(5)]
    docs = [(None, "x " + items[3][1]), (None, "clean without an id"), (7, items[0][1]), (7, "clean but its id is repeated"), (8, None)]
    got = D.remove_leaking(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "clean without an id"), (7, "clean but its id is repeated"), (8, "")]


@pytest.mark.parametrize("exact", [1 << 21, 5])
def test_an_item_depends_on_no_other(spark, monkeypatch, exact):
    monkeypatch.setattr(D, "EXACT", exact)
    rng, _ = corpus(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    para = lambda n: " ".join(word() for _ in range(n))
    head = para(4)
    items = [(k, f"{head} {para(6 + k)}. {para(7)}") for k in range(12)] + [(77, para(3000))]
    w = items[5][1].split()
    scattered = " ".join(" ".join(w[k : k + 4]) + " " + para(150) for k in range(0, len(w) - 3, 2))
    docs = [(k, para(60) + " " + t) for k, t in items] + [(500, scattered), (501, " ".join(w[:12] + w[14:]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in D.find_leaks(df, bench).collect())
    whole = found()
    assert {(k, k) for k, _ in items} <= {x[:2] for x in whole} and 500 not in {x[0] for x in whole}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    assert found() == whole


def test_length_classes():
    assert all(n <= D.room(n) <= max(4, 1.5 * n) for n in range(3, 5000))
