"""Automatic labels, augmentation, variants, encoders."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyleaf.operators import augment, autolabel


def page(spark):
    rows = [
        ("增值税普通发票", 400, 20),
        ("发票代码", 50, 60),
        ("1100123456", 200, 60),
        ("No 12345678", 600, 60),
        ("开票日期 2023年01月05日", 600, 90),
        ("校验码", 50, 120),
        ("12345678901234567890", 200, 120),
        ("购买方", 50, 200),
        ("甲方有限公司", 200, 200),
        ("91000000000000001X", 200, 240),
        ("金额", 300, 400),
        ("税额", 600, 400),
        ("¥94.34", 300, 440),
        ("¥5.66", 600, 440),
        ("价税合计(小写) ¥100.00", 500, 600),
        ("销售方", 50, 700),
        ("乙方有限公司", 200, 700),
        ("92000000000000002Y", 200, 740),
        ("开票人", 50, 900),
        ("王小明", 200, 900),
    ]
    df = spark.createDataFrame([("d", k, t, 95.0, float(x - 50), float(y - 10), float(x + 50), float(y + 10)) for k, (t, x, y) in enumerate(rows)], "doc_id string, line_no int, text string, score double, x1 double, y1 double, x2 double, y2 double")
    return rows, df


def test_auto_labels(spark):
    rows, df = page(spark)
    got = {r["class"]: rows[r.line_no][0] for r in autolabel.auto_labels(df, 800.0, 1000.0).collect()}
    assert got == {
        "invoice_type": "增值税普通发票",
        "invoice_code": "1100123456",
        "invoice_no": "No 12345678",
        "invoice_date": "开票日期 2023年01月05日",
        "checksum": "12345678901234567890",
        "buyer_name": "甲方有限公司",
        "buyer_tax_id": "91000000000000001X",
        "seller_name": "乙方有限公司",
        "seller_tax_id": "92000000000000002Y",
        "amount": "¥94.34",
        "tax": "¥5.66",
        "total": "价税合计(小写) ¥100.00",
        "drawer": "王小明",
    }


def images(spark, n=1):
    a = np.random.default_rng(0).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    return a, spark.createDataFrame([(k, str(k), 30, 40, 3, bytearray(a.tobytes())) for k in range(n)], "sample long, doc_id string, height int, width int, n_channels int, data binary")


def test_png(spark):
    a, df = images(spark)
    data = augment.png(a)
    assert struct.unpack(">II", data[16:24]) == (40, 30)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : -16])
    assert (np.frombuffer(raw, dtype=np.uint8).reshape(30, 121)[:, 1:].reshape(30, 40, 3)[..., ::-1] == a).all()
    assert augment.with_base64(df).first().image_base64.startswith("iVBOR")


def test_variants(spark):
    _, df = images(spark)
    got = augment.variants(df).orderBy("variant_no").collect()
    assert [r.variant for r in got] == ["gray", "upscaled", "clahe", "clahe_otsu", "adaptive"] and got[1].height == 60


def test_augment_depends_on_seed_and_sample_alone(spark):
    _, df = images(spark, 3)
    df = df.withColumn("boxes", F.expr("array(named_struct('cls', 3, 'x1', 5.0D, 'y1', 5.0D, 'x2', 30.0D, 'y2', 20.0D))"))
    a = {r["sample"]: (bytes(r.data), r.lines) for r in augment.augment(df).collect()}
    b = {r["sample"]: (bytes(r.data), r.lines) for r in augment.augment(df.repartition(3)).collect()}
    assert a == b and len({v[0] for v in a.values()}) == 3 and all(v[1][0].startswith("3 ") for v in a.values())


def test_scale(spark):
    scale = spark.createDataFrame([(1000, 500), (1800, 10), (5200, 10)], "h int, w int").select(augment.scale_for_ocr(F.col("h"), F.col("w")).alias("s")).collect()
    assert [r.s for r in scale] == [2.0, 1.0, 0.5]


def test_crop_and_draw():
    a = np.zeros((20, 20), dtype=np.uint8)
    assert augment.crop(a, (2, 2, 5, 5)).shape == (11, 11)
    assert augment.draw_boxes(a, [(-5, 2, 30, 8)])[2, 0].tolist() == [0, 160, 0]
    assert augment.prepare(a).shape == (40, 40, 3)
