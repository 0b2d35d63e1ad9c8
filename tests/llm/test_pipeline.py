import pytest

import corpus_pipeline as C
from tallyleaf.llm import common, pieces
from tallyleaf.llm.state import CLEANUP, Scratch


def test_stages_follow_from_each_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0
    out = C.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == sizes[4] and out.where("not round_trip").count() == 0


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0


def test_one_of_each_group_stays(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "an other text of some words that stands alone"
    rows = [(3, a), (1, a + " end"), (2, b), (2, b), (None, a), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()) == [(1, a + " end"), (2, b), (4, "")]


def test_no_second_set_of_workers(spark, monkeypatch):
    """Lists of rows and RDDs of Python start workers of their own beside those of queries."""
    pieces_ = pieces.Pieces(pieces.model_path())
    want = sorted((t, i, float(s)) for t, (i, s) in pieces_.normal.items())
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("an RDD of Python objects"))
    assert sorted(map(tuple, pieces_.table(spark).collect())) == want
    assert pieces_.table(spark).dtypes == [("piece", "string"), ("id", "int"), ("score", "double")]


def test_memory_goes_back_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": lambda _, n: calls.append(n)})())
    got = common.tidied(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(got) == 2 and not calls
    assert list(got) == [4] and calls == [0]


def test_scratch_leaves_the_session_as_it_was(spark, tmp_path):
    settings = lambda: [spark.conf.get("spark.sql.maxPlanStringLength"), spark.conf.get(CLEANUP, "false")]
    before = settings()
    assert Scratch(spark, "test").keep(spark.range(3)).count() == 3
    assert settings() == before
