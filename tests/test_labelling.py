from pyspark.sql import functions as F

from tallyleaf.operators import dataset, labelling

BOXES = "image string, det_no int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_detected_labels(spark):
    images = spark.createDataFrame([(f"{k}.jpg", None if k == 3 else 100, 50) for k in range(5)], "image string, width int, height int")
    rows = [("0.jpg", 1, 8, 0.5, -10.0, 10.0, 30.0, 20.0), ("0.jpg", 0, 0, 0.25, 50.0, 0.0, 200.0, 49.0), ("0.jpg", 2, 13, 0.9, 0.0, 0.0, 9.0, 9.0), ("0.jpg", 3, -1, 0.9, 0.0, 0.0, 9.0, 9.0), ("1.jpg", 0, 1, 0.9, 5.0, 5.0, 5.0, 9.0), ("3.jpg", 0, 1, 0.9, 0.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, BOXES)
    out = labelling.detected_labels(images, boxes, share=0.4)
    got = {r.image: r for r in out.collect()}
    assert [got[f"{k}.jpg"].split for k in range(5)] == ["train"] * 3 + ["val"] * 2
    assert got["0.jpg"].label == "0 0.745000 0.490000 0.490000 0.980000\n8 0.150000 0.300000 0.300000 0.200000\n"
    assert got["0.jpg"].classes == ["invoice_type", "seller_tax_id"] and got["0.jpg"].detections == 2
    assert (got["1.jpg"].label, got["1.jpg"].detections, got["1.jpg"].classes) == ("", 0, [])
    assert got["3.jpg"].error and got["3.jpg"].label is None
    sure = labelling.detected_labels(images, boxes, with_confidence=True).where("image = '0.jpg'").first()
    assert [line.split(" ")[-1] for line in sure.label.splitlines()] == ["0.250000", "0.500000"]
    one = labelling.report(out).first()
    assert (one.images, one.train, one.val, one.boxes, one.class_counts["invoice_type"], one.class_counts["tax"]) == (5, 3, 2, 2, 1, 0)
    none = labelling.report(out.limit(0)).first()
    assert (none.images, none.boxes, none.class_counts["total"]) == (0, 0, 0)


def test_converted(spark):
    square = "[[10,10],[60,10],[60,30],[10,30]]"
    node = lambda i, text, label, links="[]", at=square: f'{{"id":{i},"transcription":"{text}","label":"{label}","linking":{links},"points":{at}}}'
    told = "[" + ",".join([node(1, "价税合计", "question", "[[1,2]]"), node(2, " 9.00 ", "answer"), node(3, "开票日期", "question", "[[3,4]]"), node(4, "thin", "answer", at="[[0,0],[1,0],[1,1]]")]) + "]"
    lines = spark.createDataFrame([("train", f"a.jpg\t{told}"), ("val", "b.jpg\t[]"), ("val", f"no size.jpg\t{told}")], "split string, value string")
    nodes = lines.select("split", F.split("value", "\t").alias("p"), "value")
    parsed = dataset.parse_annotations(lines).join(nodes.select("split", F.get("p", F.lit(0)).alias("image")), "image")
    sizes = spark.createDataFrame([("a.jpg", 100, 100), ("b.jpg", 100, 100)], "image string, width int, height int")
    got = {r.image: r for r in labelling.converted(parsed, sizes).collect()}
    assert (got["a.jpg"].classes, got["a.jpg"].texts) == (["total"], ["9.00"]) and got["a.jpg"].label == "11 0.350000 0.200000 0.500000 0.200000\n"
    assert (got["b.jpg"].split, got["b.jpg"].label, got["b.jpg"].classes) == ("val", "", []) and set(got) == {"a.jpg", "b.jpg"}
    one = labelling.report(labelling.converted(parsed, sizes)).first()
    assert (one.train, one.val, one.class_counts["total"]) == (1, 1, 1)


def test_originals(spark):
    images = spark.createDataFrame([("train", "x/a.b.jpg", "s1"), ("val", ".hidden", "s2")], "split string, path string, source string")
    labels = spark.createDataFrame([("train", "a.b", "1 2\n"), ("train", ".hidden", "other split")], "split string, stem string, text string")
    got = sorted(tuple(r) for r in labelling.originals(images, labels).collect())
    assert got == [("s1", "images/train/x/a.b.jpg", "labels/train/a.b.txt", "1 2\n"), ("s2", "images/val/.hidden", "labels/val/.hidden.txt", "")]
