import random

import pytest

from tallyleaf.llm import pieces as P


@pytest.fixture(scope="module")
def table():
    return P.Pieces(P.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


TEXTS = ["Hello  world", " a b ", "a\nb\tc", "é ñ ß ﬁ Ａ", "", "  ", "x　y", "emoji 😀!", "12345 www", "\n\n \n", "a" * 5000, "über " * 50, "\x00\x07"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library_and_come_back(table, library, text):
    ids = P.encoded(text, P.Memory({}, table))
    assert ids == library.encode(text)
    assert P.decode_ids(ids, table.texts, {i: b for b, i in table.bytes.items()}) == text


def best_path(word, table):
    """All paths of a short word."""
    if not word:
        return 0.0
    out = []
    for n in range(1, len(word) + 1):
        hit = table.normal.get(word[:n])
        if hit or n == 1:
            out.append((hit[1] if hit else table.unknown) + best_path(word[n:], table))
    return max(out)


def test_viterbi_finds_the_best_path(table):
    rng = random.Random(5)
    score = {i: s for i, s in table.normal.values()}
    for _ in range(200):
        word = "".join(rng.choice("▁theoanrßx") for _ in range(rng.randrange(1, 8)))
        total = sum(score[i] for i in P.viterbi(word, table) if i in score)
        if all(i in score for i in P.viterbi(word, table)):
            assert total == pytest.approx(best_path(word, table))


def test_relational_lattice_equals_the_local_one(spark, table):
    words = ["▁the", "▁", "thor", "▁ñandú", "▁über", "😀x", "▁information", "zq", "▁▁", "áb", "12"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for by_merges, local in ((False, P.viterbi), (True, P.merged)):
        got = {r.word: tuple(r.ids) for r in P.lexicon(df, table.table(spark), table.longest, table.unknown, table.bytes[0], by_merges).collect()}
        assert got == {w: local(w, table) for w in words}


def test_words_of_a_batch_merge_together(table):
    rng = random.Random(6)
    words = {"▁" * rng.randrange(2) + "".join(rng.choice("theoanrs▁xé12ñ—字") for _ in range(rng.randrange(1, 23))) for _ in range(5000)}
    got = dict(P.Merger(table)(words | {"", "\U000F1234", "▁a\U000F1234b", "a" * 30}))
    assert got.keys() == {w for w in words if len(P.merged(w, table)) and not set(P.merged(w, table)) & set(table.bytes.values())}
    assert all(ids == P.packed(P.merged(w, table)) for w, ids in got.items())
    # so no word of a usual text is taken by itself
    memory = P.Memory({}, table)
    memory.found = None
    text = " ".join(w.replace("▁", "x") for w in got if len(w) < 20)
    assert P.encoded(text, memory)


def test_encode_decode_tables(spark):
    rows = [(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (4, "word\nTwo  é", "c"), (4, "word\nTwo  é", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = P.decode(P.encode(df, P.model_path(), most=10), P.model_path()).collect()
    assert sorted((r.text or "", r.decoded) for r in back) == sorted((t or "", t or "") for _, t, _ in rows)
    digest = P.encode_digest(df, P.model_path(), most=10).collect()
    assert all(r.round_trip for r in digest) and len(digest) == 5
    assert P.encode_digest(df.limit(0), P.model_path()).count() == 0


def test_frequent_words_over_many_partitions(spark):
    from collections import Counter

    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(60)) for _ in range(90)]
    n = Counter(w for t in texts for w in t.split(" "))
    want = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        for most in (7, 120, 1000):
            got = [r.word[1:] for r in P.frequent_words(docs, most).collect()]
            assert sorted(got) == sorted(want[:most])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
