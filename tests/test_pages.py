"""Choices from whole pages: crops put in order, layout, ways of recognition."""

import pytest
from pyspark.sql import functions as F

from tallyleaf.functions import values as V
from tallyleaf.operators import autolabel, detections, fusion, layout, recognise

CROPS = "doc_id string, det_no int, field string, confidence double, x1 int, y1 int, x2 int, y2 int, text string, ocr_confidence double"
LINES = "doc_id string, line_no int, text string, score double, x1 double, y1 double, x2 double, y2 double"


def crop(n, field, text, x=0, y=100, confidence=50.0, doc="d", ocr=0.0):
    return (doc, n, field, confidence, x, y, x + 100, y + 20, text, ocr)


def resolved(spark, *rows, height=1000.0):
    got = detections.resolve_pages(detections.crop_pages(spark.createDataFrame(list(rows), CROPS)), height).first().resolved
    return [(r.field, r.det_no, r.text, r.chosen) for r in got]


def test_a_crop_of_signs_has_no_text(spark):
    assert resolved(spark, crop(0, "total", " :|", confidence=60.0), crop(1, "total", "¥1.00")) == [("total", 1, "¥1.00", True)]
    assert resolved(spark, crop(0, "drawer", None), crop(1, "note", "；")) == []


def test_ties_go_to_the_first_crop(spark):
    assert resolved(spark, crop(2, "drawer", "甲"), crop(0, "drawer", "乙"), crop(1, "drawer", "丙"))[0] == ("drawer", 0, "乙", True)


def test_near_ties_are_decided_by_the_order_of_arithmetic(spark):
    # 1 + 15 + 4.5 + 418 / 1000 * 35 + 25 is one bit under 15 + 15 + 4.5 + 18 / 1000 * 35 + 25
    assert resolved(spark, crop(0, "total", "¥1.00", y=408, confidence=1.0, ocr=90.0), crop(1, "total", "¥2.00", y=8, confidence=15.0, ocr=90.0))[0][1] == 1
    # equal with 887 / 1000 * 10 and 17 / 1000 * 10, not with 8870 / 1000 and 170 / 1000
    assert resolved(spark, crop(0, "amount", "¥1.00", y=877, confidence=21.0, ocr=90.0), crop(1, "amount", "¥2.00", y=7, confidence=1.0, ocr=90.0))[0][1] == 0


def test_leftovers_come_from_top_to_bottom(spark):
    rows = [crop(0, "drawer", "王小明", confidence=90.0), crop(1, "x", "low", y=300), crop(2, "y", "right", x=50, y=20), crop(3, "z", "left", x=10, y=20), crop(4, "w", "sure", x=10, y=20, confidence=70.0)]
    assert [r[1] for r in resolved(spark, *rows)] == [0, 4, 3, 2, 1]
    crops = spark.createDataFrame(rows, CROPS)
    rest = detections.leftovers(crops, detections.resolve(crops, 1000.0)).orderBy("place").collect()
    assert [(r.place, r.det_no) for r in rest] == [(0, 4), (1, 3), (2, 2), (3, 1)]


def test_amount_and_tax_change_places_when_crossed(spark):
    both = [crop(0, "amount", "¥6.00", x=500, y=400), crop(1, "tax", "¥94.00", x=100, y=400)]
    assert [(r[0], r[1]) for r in resolved(spark, *both)] == [("amount", 1), ("tax", 0)]
    apart = [crop(0, "amount", "¥6.00", x=500, y=400), crop(1, "tax", "¥94.00", x=100, y=500)]
    assert [(r[0], r[1]) for r in resolved(spark, *apart)] == [("amount", 0), ("tax", 1)]


def test_filters_fall_back(spark):
    # no seller name but noise: none; an id without digits is taken only for want of another
    assert resolved(spark, crop(0, "seller_name", "发票专用章")) == [("seller_name", 0, "发票专用章", False)]
    ids = [crop(0, "buyer_tax_id", "账号", confidence=99.0), crop(1, "buyer_tax_id", "91000000000000001X", confidence=10.0)]
    assert resolved(spark, *ids)[0][1] == 1 and resolved(spark, ids[0])[0] == ("buyer_tax_id", 0, "账号", True)
    assert resolved(spark, crop(0, "checksum", "12345"))[0][3] is False


def test_detected_text(spark):
    rows = [crop(0, "drawer", "王小明"), crop(1, "total", "|¥100.00；"), crop(2, "odd", "样张"), crop(3, "total", " ")]
    page = detections.resolve_pages(detections.crop_pages(spark.createDataFrame(rows, CROPS)), 1000.0)
    text = page.select(detections.detected_text(F.col("resolved"), F.lit("全文")).alias("t"), detections.detected_text(F.col("resolved"), F.lit("")).alias("u")).first()
    assert text.t == "价税合计:¥100.00\n开票人:王小明\nodd:样张\nOCR全文:\n全文" and text.u == "价税合计:¥100.00\n开票人:王小明\nodd:样张"
    record = fusion.parse(page.select("doc_id", detections.detected_text(F.col("resolved")).alias("text"))).first()
    assert (record.total, record.drawer) == ("100.00", "王小明")


def lines(spark, *rows):
    return spark.createDataFrame([("d", k, t, 90.0, float(x), float(y), x + 200.0, y + 20.0) for k, (t, x, y) in enumerate(rows)], LINES)


def test_layout_takes_what_lies_in_the_regions(spark):
    page = lines(spark, ("购买方", 10, 180), ("名称:甲方有限公司", 10, 200), ("税号 91000000000000001X", 10, 240), ("金额 ¥94.00", 10, 500), ("税额 ¥6.00", 400, 500), ("价税合计(小写) ¥100.00", 10, 640), ("销售方", 10, 690), ("名称:乙方有限公司", 10, 700), ("税号 92000000000000002Y", 10, 740), (" ", 0, 0), ("开票人:王小明", 10, 900))
    empty = spark.createDataFrame([("d", *[""] * 13), ("none", *["x"] * 13)], "doc_id string, " + ", ".join(f"{f} string" for f in V.FIELDS))
    got = {r.doc_id: r for r in layout.refine(empty, page, 1000.0, 800.0).collect()}
    d = got["d"]
    assert (d.buyer_name, d.buyer_tax_id, d.seller_name, d.seller_tax_id, d.drawer) == ("甲方有限公司", "91000000000000001X", "乙方有限公司", "92000000000000002Y", "王小明")
    assert (d.amount, d.tax, d.total, d.checksum) == ("94.00", "6.00", "100.00", "")
    # a page without lines keeps its record, though buyer and seller are one
    assert set(got["none"][1:]) == {"x"}


def request(doc, mode, pdf=None, ocr=None, error=None):
    return (doc, mode, pdf, ocr, 70.0, error)


REQUEST = "doc_id string, mode string, pdf_text string, ocr_text string, ocr_confidence double, detector_error string"
SUITABLE = "增值税普通发票\n发票代码:110012345678\n开票人:王小明"


def test_ways(spark):
    rows = [
        request("pdf", "force", pdf=SUITABLE * 2),
        request("short pdf", None, pdf="x", ocr=SUITABLE),
        request("off", "off", ocr=SUITABLE),
        request("auto", "auto", ocr=SUITABLE),
        request("skipped", "auto", ocr="收据"),
        request("fallback", "auto", ocr=SUITABLE, error="gone"),
        request("force", "force"),
        request("failed", "force", ocr=SUITABLE, error="gone"),
        request("nothing", "auto"),
    ]
    crops = spark.createDataFrame([crop(0, "total", "¥5.00", doc=d, ocr=80.0) for d in ("auto", "force", "off", "failed")], CROPS)
    page = lines(spark, ("开票人:李芳", 10, 900)).withColumn("doc_id", F.lit("force"))
    out = recognise.recognise(recognise.page_table(spark.createDataFrame(rows, REQUEST), page, crops), 1000.0, 800.0)
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.way for d, r in got.items()} == {"pdf": "skipped_pdf_text", "short pdf": "off", "off": "off", "auto": "auto", "skipped": "auto_skipped", "fallback": "auto_fallback", "force": "force", "failed": "failed", "nothing": "auto_skipped"}
    assert {d for d, r in got.items() if r.total == "5.00"} == {"auto", "force"}
    assert got["auto"].text == f"价税合计:¥5.00\nOCR全文:\n{SUITABLE}" and got["auto"].drawer == "王小明" and got["auto"].invoice_code == "110012345678"
    assert got["force"].text == "价税合计:¥5.00\nOCR全文:\n开票人:李芳" and got["force"].drawer == "李芳"
    assert [got[d].average_confidence for d in ("pdf", "off", "auto", "failed")] == [100.0, 70.0, 80.0, 0.0]
    assert got["failed"].text == "" and got["failed"].score == 0 and got["failed"].checks.total.level == "missing"
    assert got["fallback"].reason.endswith("YOLO 不可用，已回退普通 OCR：gone")
    assert out.where("way = 'auto'").count() == 1


@pytest.mark.parametrize("build", ["labels", "resolve", "recognise"])
def test_one_scan_and_no_join_a_page(spark, build):
    crops, page = spark.createDataFrame([crop(0, "total", "1.00")], CROPS), lines(spark, ("x", 1, 1))
    if build == "labels":
        df, most = autolabel.auto_labels(page, 800.0, 1000.0), 1
    elif build == "resolve":
        df, most = detections.resolve(crops, 1000.0), 1
    else:
        df, most = recognise.recognise(spark.createDataFrame([(*request("d", "force"), [], [])], f"{REQUEST}, lines array<struct<y1:double,x1:double,line_no:int,text:string,score:double,x2:double,y2:double>>, crops array<struct<det_no:int,field:string,confidence:double,x1:int,y1:int,x2:int,y2:int,text:string,ocr_confidence:double>>"), 1000.0, 800.0), 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan and "Window" not in plan
    physical = df._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in physical and physical.count("ObjectHashAggregate") <= 2 * most
