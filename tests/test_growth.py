"""Steps that cost too much on large tables: what must be done once, in the row, or on all cores."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyleaf.functions import extract as X
from tallyleaf.functions import text as T
from tallyleaf.functions import values as V
from tallyleaf.operators import dataset, detections, fusion, layout, regions, views

SF = "/root/testdata/sf0.001"
LINES = "doc_id long, lines array<struct<y1:double,x1:double,line_no:int,text:string,score:double,x2:double,y2:double>>"


def plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def page(*texts):
    return [(40.0 * k, 100.0, k, t, 95.0, 300.0, 40.0 * k + 20) for k, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["auto_labels_placed", "auto_labels_form", "layout_refine", "amount_tax_total_layout", "region_assign", "layout_tax_ids", "layout_checksum"])
def test_lines_of_a_page_are_never_collected(spark, name):
    df = entry.queries()[name](spark, SF)
    assert "collect_list" not in plan(df) and plan(df).count("Scan parquet") == 2


@pytest.mark.parametrize("make", [lambda p: layout.page_regions(p, 640.0), lambda p: layout.page_checksum(p, 640.0), lambda p: layout.page_tax_ids(p, 640.0)])
def test_items_of_a_page_are_made_once(spark, make):
    pages = spark.createDataFrame([(1, page("校验码:123456789012")), (2, page(" ")), (3, None)], LINES)
    assert plan(make(pages), "optimizedPlan").count("array_sort") == 1
    assert {r.doc_id for r in make(pages).collect()} <= {1}


def test_parsing_is_dealt_out(spark):
    for name in ("pdf_tail_assign", "kie_link_join", "augmented_labels"):
        assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, SF))


def test_annotations_are_read_once(spark):
    assert plan(entry.queries()["kie_link_join"](spark, SF)).count("Scan parquet") == 1


@pytest.mark.parametrize("name", ["edges_8x8", "text_regions_8x8"])
def test_images_are_dealt_out_and_linked_in_their_row(spark, name):
    found = plan(entry.queries()[name](spark, SF))
    assert found.count("MapInArrow") == 1 and "REPARTITION_BY_NUM" in found and "ExistingRDD" not in found


def test_few_pixels_at_once(monkeypatch):
    monkeypatch.setattr(regions, "PORTION", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([[1], [2, 3], [4], [5] * 9, [], [6]])], names=["l"])
    assert [b.column(0).to_pylist() for b in regions.portions([batch], 0)] == [[[1], [2, 3], [4]], [[5] * 9], [[], [6]]]


def test_links_go_across_the_lines_of_an_image(spark):
    node = lambda i, label, links, text="t": (i, text, label, links, [[0.0, 0.0], [9.0, 9.0]])
    rows = [
        ("a", [node(1, "question", [[1, 7], [1, 8], [2, 7], [1], None])]),
        ("a", [node(7, "answer", [], "first"), node(7, "answer", [], "last")]),
        (None, [node(1, "question", [[1, 2]]), node(2, "answer", [])]),
        ("b", None),
        ("c", [node(1, "question", None), node(2, "answer", None)]),
    ]
    got = dataset.linked_pairs(spark.createDataFrame(rows, f"image string, nodes {dataset.NODES}")).collect()
    assert [(r.image, r.link_no, r.answer.transcription) for r in got] == [("a", 0, "last")]


def test_moved_lines_as_one_by_one(spark):
    turn = [0.9, 0.1, 5.0, -0.1, 1.1, 3.0, 0.0001, 0.0002, 1.0]
    df = spark.createDataFrame([(turn, 1, 10.0, 20.0, 200.0, 90.0), ([0.0] * 9, 2, 1.0, 1.0, 50.0, 50.0), (None, 3, 1.0, 1.0, 50.0, 50.0), (turn, 4, 700.0, 400.0, 650.0, 450.0)], "view array<double>, c int, x1 double, y1 double, x2 double, y2 double")
    box = ("x1", "y1", "x2", "y2")
    both = views.moved_lines(df, "view", "c", box, 800, 500).withColumn("other", views.moved_line(F.col("view"), F.col("c"), tuple(map(F.col, box)), F.lit(800), F.lit(500)))
    assert "transform" not in plan(views.moved_lines(df, "view", "c", box, 800, 500))
    rows = both.collect()
    assert [r.line for r in rows] == [r.other for r in rows] and rows[0].line and not rows[2].line


@pytest.mark.parametrize("words", [V.STAMP_NOISE, V.NAME_NOISE, V.BLOCK_WORDS, V.BUYER_STOPS, tuple(V.ORG_SUFFIX.split("|"))])
def test_words_are_found_without_patterns(spark, words):
    texts = [*words, *(w[:-1] for w in words), *(f"x{w}y" for w in words), "", "公", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.contains_any(F.col("t"), words).alias("got"), F.col("t").rlike("|".join(words)).alias("want"))
    assert "RLIKE" not in plan(df.select("got"))
    assert all(r.got == r.want for r in df.collect())


def test_names_and_blanks(spark):
    texts = ["王小明", "财务", "管理员", "王", "欧阳", "欧阳明", "王小明公司", "开票人", "管理员一二三", "", "　王 小\x1c明\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_person(F.col("t")).alias("p"), T.squeeze(F.col("t")).alias("s"), F.regexp_replace(F.coalesce("t", F.lit("")), f"{T.BLANK}+", "").alias("want")).collect()
    assert [bool(r.p) for r in rows] == [True, True, True, False, False, True, False, False, False, False, True, False]
    assert all(r.s == r.want for r in rows)


def test_what_is_asked_of_few_crops_is_not_found_for_all(spark):
    crops = spark.createDataFrame([(1, [(0, "total", 50.0, 0, 0, 9, 9, "¥1.00", 80.0)])], "doc_id long, crops array<struct<det_no:int,field:string,confidence:double,x1:int,y1:int,x2:int,y2:int,text:string,ocr_confidence:double>>")
    facts = crops.select(F.transform("crops", detections.crop_facts).alias("c")).schema["c"].dataType.elementType
    assert not {"money", "id", "check", "noisy"} & set(facts.names)
    texts = ["¥1.00", "1.5", "x.1", "1.", ".5", "12,345.6", "1 .5", "一.二", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.has_money(F.col("t")).alias("got"), F.col("t").rlike("[¥￥]?(?U)\\s*[0-9]{1,12}(?:,[0-9]{3})*\\.[0-9]{1,2}").alias("want")).collect()
    assert all(r.got == r.want for r in rows)


def test_lines_that_need_no_cleaning_are_left_alone(spark):
    texts = ["甲\n乙:丙", "甲\n\n乙", " 甲\n乙", "甲：\n乙", "名称:甲\n乙", "甲||乙\n丙", "1,2\n3", "甲\r\n乙", "甲\r \n乙", "甲\u2028乙", "a\x1d", "\n", "", "（甲）\n乙\xa0", "甲＃乙", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.clean_lines(F.col("t")).alias("got"), F.transform(F.split("t", T.LINE_END), T._clean).alias("want"), X.kept_lines(F.col("t")).alias("kept"), F.transform(F.filter(F.split("t", T.LINE_END), lambda x: T._clean(x) != ""), lambda x: F.translate(x, "￥： ", "¥:")).alias("norm")).collect()
    assert all(r.got == r.want and r.kept == r.norm for r in rows)
    assert [r.t.rstrip() for r in df.where(~F.concat(F.lit("\n"), "t", F.lit("\n")).rlike(T.SPOILT_TEXT)).collect()] == ["甲\n乙:丙", "甲＃乙"]


def test_cents_as_by_decimals(spark):
    texts = ["0.00", "94.00", "999999999999999.99", "1234567890123456.00", "1", "1.5", "1.005", "0.0049999", "1,000.00", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.cents(F.col("t")).alias("got"), T._cents(F.col("t")).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[2].got == 99999999999999999


def test_companies_are_not_sought_in_lines_that_nobody_asks_for(spark):
    found = plan(fusion.parse(spark.createDataFrame([(1, "x")], "doc_id long, text string")), "optimizedPlan")
    # only behind a condition or in a fold that ends, so no column holds the company of each line
    assert "AS _found" not in found and "AS _firms" in found and "CASE WHEN (seller_name" in found.split("AS _firms")[0].split("Project")[-1]


@pytest.mark.parametrize(("text", "want"), [("价税合计\n甲公司", "甲公司"), ("价税合计\n乙公司\n小写\n甲公司", "甲公司"), ("价税合计" + "\n一" * 34 + "\n甲公司", ""), ("价税合计" + "\n一" * 30 + "\n小写" + "\n一" * 20 + "\n甲公司", "甲公司"), ("甲公司", ""), ("销售方\n甲公司", "甲公司"), ("", "")])
def test_seller_within_reach_of_a_mark(spark, text, want):
    df = spark.createDataFrame([(text.replace("甲公司", "甲丙有限公司").replace("乙公司", "乙丁有限公司"),)], "t string")
    assert df.select(X.seller_name(F.col("t"), F.lit("乙丁有限公司")).alias("v")).first().v == want.replace("甲公司", "甲丙有限公司")
