from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.operators import dataset
from tallyleaf.plans import catalogue


def test_short_items_are_found(spark, tmp_path):
    docs = [(1, "one two three four five six seven eight"), (2, "xxab cdyy"), (3, ""), (4, None), (5, "zo two threexx")]
    items = [(1, "wo three fou"), (2, "ab cd"), (3, "q"), (4, "o"), (5, "e two three four five six sev"), (6, ""), (7, "two three")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.doc_id) for r in catalogue.benchmark_overlap(spark, str(tmp_path)).collect())
    assert got == sorted((i, j) for i, t in items for j, x in docs if x is not None and t in x)


def test_crop_text_of_null_and_signs(spark):
    df = spark.createDataFrame([(None,), (" : |\n",), (" a；\r\n\n，b ",)], "t string")
    assert [r.x for r in df.select(T.clean_crop(F.col("t")).alias("x")).collect()] == ["", "", "a\nb"]


def test_gate_of_no_files(spark):
    row = dataset.gate(spark.createDataFrame([], "path string"), "path", 100, 100).first()
    assert (row.images, row.labels, row.bad_files, row.ok) == (0, 0, 0, False)


def test_gate_counts(spark):
    good = [(f"d/images/train/{k}.jpg",) for k in range(3)] + [(f"d/labels/val/{k}.txt",) for k in range(3)]
    gate = lambda rows: tuple(dataset.gate(spark.createDataFrame(rows, "path string"), "path", 3, 3).first())
    assert gate(good) == (3, 3, 0, True)
    assert gate(good[1:]) == (2, 3, 0, False)
    assert gate([*good, ("d/labels/classes.txt",)]) == (3, 3, 1, False)
    # a stray file among the labels is counted as both
    assert gate([*good, ("d/labels/train/label.txt",)]) == (3, 4, 1, False)
