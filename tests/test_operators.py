"""Raster array forms, engines, sources, sinks, dataset helpers, streaming."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import dataset, detections, engines, raster
from tallyleaf.sources import files, sinks
from tallyleaf.streaming import ingest


def image(h=40, w=60, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


@pytest.mark.parametrize("key", sorted(raster.PROCESSORS))
def test_every_processor(key):
    out = raster.PROCESSORS[key](image())
    assert out.dtype == np.uint8 and out.size


def test_array_and_relational_forms_agree(spark):
    a = np.random.default_rng(3).integers(0, 256, (8, 8), dtype=np.uint8)
    px = spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(8) for c in range(8)], "img int, r int, c int, v int")
    back = lambda df: np.array([x.v for x in df.orderBy("r", "c").collect()]).reshape(8, 8)
    assert (back(raster.stretch(px)) == raster.PROCESSORS["stretch"](a)).all()
    assert (back(raster.binarize(px)) == raster.PROCESSORS["otsu"](a)).all()
    assert (back(raster.median(px, 8)) == raster.PROCESSORS["denoise"](a)).all()
    assert (back(raster.laplacian(px, 8)) == raster.PROCESSORS["laplacian"](a)).all()
    assert (back(raster.morph_open(px, 8)) == raster.PROCESSORS["morph_open"](a)).all()


STEPS = {
    "open": lambda px: raster.morph_open(px, 8),
    "close": lambda px: raster.morph_close(px, 8),
    "gradient": lambda px: raster.morph_gradient(px, 8),
    "mean": lambda px: raster.box_mean(px, 8),
    "median": lambda px: raster.median(px, 8),
    "sobel": lambda px: raster.sobel(px, 8),
    "laplacian": lambda px: raster.laplacian(px, 8),
    "clahe": lambda px: raster.clahe(px, 40.0, 2),
}


@pytest.mark.parametrize("step", STEPS)
def test_pixels_stay_out_of_the_driver(spark, step):
    # the planner thinks that exploded arrays are small, so a join on pixels would broadcast them
    px = raster.grid(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "vec_id", "embedding", 8)
    assert "Broadcast" not in STEPS[step](px)._jdf.queryExecution().executedPlan().toString()


def test_extremes_of_an_image_with_gaps(spark):
    rng = np.random.default_rng(5)
    a = {(r, c): int(rng.integers(0, 256)) for r in range(7) for c in range(9) if rng.random() < 0.4}
    px = spark.createDataFrame([(0, r, c, v) for (r, c), v in a.items()], "img int, r int, c int, v int")
    near = lambda r, c: [v for (y, x), v in a.items() if abs(y - r) <= 2 and abs(x - c) <= 2]
    got = {(x.r, x.c): (x.lo, x.hi) for x in raster.extremes(px, 2, lo=F.min, hi=F.max).collect()}
    assert got == {at: (min(near(*at)), max(near(*at))) for at in a}


def test_adaptive_threshold(spark):
    a = np.random.default_rng(4).integers(0, 256, (13, 21), dtype=np.uint8)
    px = spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(13) for c in range(21)], "img int, r int, c int, v int")
    for block, less in ((35, 11), (4, 3), (1, 0)):
        got = np.array([x.v for x in raster.adaptive_threshold(px, block, less).orderBy("r", "c").collect()]).reshape(13, 21)
        assert (got == raster._adaptive(a, max(3, block), less)).all()
    assert raster.adaptive_threshold(px.limit(0)).count() == 0


def clahe(a, clip, tiles):
    """Pixel by pixel, as the docstring of the relational form says."""
    (h, w), whole = a.shape, a.shape[0] % tiles == 0 and a.shape[1] % tiles == 0
    fh, fw = (n if whole else n + tiles - n % tiles for n in (h, w))
    at = lambda k, n: k if k < n else 2 * (n - 1) - k
    th, tw = fh // tiles, fw // tiles
    limit, table = max(1, int(clip * th * tw / 256)), {}
    for i in range(tiles):
        for j in range(tiles):
            n = [0] * 256
            for r in range(i * th, (i + 1) * th):
                for c in range(j * tw, (j + 1) * tw):
                    n[a[at(r, h), at(c, w)]] += 1
            over = sum(max(0, x - limit) for x in n)
            n = [min(x, limit) + over // 256 for x in n]
            left, k = over % 256, 0
            step = max(1, 256 // max(1, left))
            while k < 256 and left:
                n[k], left, k = n[k] + 1, left - 1, k + step
            table[i, j] = [min(255, round(x * 255 / (th * tw))) for x in np.cumsum(n).tolist()]
    out = np.zeros_like(a)
    for r in range(h):
        for c in range(w):
            y, x = r / th - 0.5, c / tw - 0.5
            i, j = math.floor(y), math.floor(x)
            to = lambda i, j: table[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1)][a[r, c]]  # noqa: B023, E731
            fy, fx = y - i, x - j
            out[r, c] = round(round((1 - fy) * ((1 - fx) * to(i, j) + fx * to(i, j + 1)) + fy * ((1 - fx) * to(i + 1, j) + fx * to(i + 1, j + 1)), 6))
    return out


@pytest.mark.parametrize(("h", "w", "clip", "tiles"), [(16, 24, 2.0, 8), (13, 22, 40.0, 4), (9, 8, 900.0, 2)])
def test_clahe(spark, h, w, clip, tiles):
    a = np.random.default_rng(h).integers(0, 256, (h, w), dtype=np.uint8) // 9 * 9
    px = spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(h) for c in range(w)], "img int, r int, c int, v int")
    got = np.array([x.v for x in raster.clahe(px, clip, tiles).orderBy("r", "c").collect()]).reshape(h, w)
    assert (got == clahe(a, clip, tiles)).all()


def images(spark, n=2):
    return spark.createDataFrame([(str(k), 40, 60, 3, bytearray(image(seed=k).tobytes())) for k in range(n)], "doc_id string, height int, width int, n_channels int, data binary")


def test_process_chain(spark):
    out = raster.process(images(spark), ["gray", "invert"]).collect()
    assert all(r.n_channels == 1 and r.error is None for r in out)
    assert (np.frombuffer(out[0].data, dtype=np.uint8).reshape(40, 60) == 255 - raster.to_gray(image(seed=0))).all()
    with pytest.raises(ValueError):
        raster.process(images(spark), ["no such"])


def test_engines(spark):
    ocr = engines.recognize_lines(images(spark), "stub", lambda: lambda a: [("发票", 0.9, (0, 0, 5, 5))])
    assert ocr.first().score == 90.0
    boxes = engines.detect(images(spark), "boxes", lambda: lambda a: [{"label": "date", "confidence": 0.5, "box": [1.5, 2.5, 90, 90]}, {"label": "x", "confidence": 0.1, "box": [0, 0, 1, 1]}]).collect()
    assert [(b.field, b.x1, b.y1, b.x2, b.y2) for b in boxes] == [("invoice_date", 2, 2, 60, 40)] * 2

    def broken():
        def run(_):
            raise RuntimeError("no model")

        return run

    assert "no model" in engines.recognize_lines(images(spark, 1), "broken", broken).first().error


def test_modes_and_decisions(spark):
    assert [engines.detector_mode(x) for x in ("true", "YOLO", "auto", "", "no")] == ["force", "force", "auto", "off", "off"]
    text = spark.createDataFrame([("",), ("电子发票",), ("增值税普通发票",), ("x",)], "t string")
    assert text.select(engines.decision(F.col("t")).alias("d")).distinct().count() == 4


def test_detection_json(spark):
    rows = [("a", '{"detections":[{"class":"date","score":0.5,"bbox":[1,2,3,4]}]}'), ("b", '[{"name":"x","conf":70,"xyxy":[0,0,9,9]},{"label":"y"}]'), ("c", "no json")]
    got = detections.from_json(spark.createDataFrame(rows, "doc_id string, p string"), "p", 100, 100).collect()
    assert sorted((r.doc_id, r.field, r.confidence) for r in got) == [("a", "invoice_date", 50.0), ("b", "x", 70.0)]


def test_best_ties_go_to_the_first(spark):
    rows = [("d", k, "total", 50.0, 0, 10, 10, 20, "1.00", 0.0) for k in (2, 0, 1)]
    crops = spark.createDataFrame(rows, "doc_id string, det_no int, field string, confidence double, x1 int, y1 int, x2 int, y2 int, text string, ocr_confidence double")
    assert detections.best_per_field(crops).first().det_no == 0
    assert detections.leftovers(crops, detections.best_per_field(crops)).count() == 2


def test_label_lines(spark):
    bad = spark.createDataFrame([("1 .5 .5 .2 .2",), ("1 .5 .5",), ("a b c d e",), ("1 .5 .5 0 .2",), ("",)], "value string")
    assert dataset.parse_labels(bad).count() == 1


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(12)


def test_sources(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train/a.JPG").write_bytes(jpeg(64, 32))
    (tmp_path / "train/._b.jpg").write_bytes(b"x")
    found = files.with_jpeg_size(files.image_files(spark, str(tmp_path))).select("width", "height", files.split_of(F.col("path")).alias("s")).collect()
    assert [tuple(r) for r in found] == [(64, 32, "train")]
    assert files.jpeg_size(b"nope") is None


def test_pdf_pages(spark):
    class Reader:
        def pages(self, content):
            if content == b"bad":
                raise ValueError("broken")
            return 3

        def text(self, content, page):
            return f"p{page + 1}"

        def image(self, content, page, zoom):
            return np.zeros((2, 2, 3), dtype=np.uint8)

    df = spark.createDataFrame([("a", bytearray(b"%PDF")), ("b", bytearray(b"bad"))], "path string, content binary")
    pages = files.pdf_pages(df, Reader())
    assert pages.where("error is not null").count() == 1
    assert files.pdf_text(pages, 9).first().text == "p3"
    assert files.pdf_text(pages, 0, 2).first().text == "p1\np2"
    assert df.where(files.is_pdf(F.col("path"), F.col("content"))).count() == 1


def test_run_metrics(spark, tmp_path):
    for run, rows in (("sweep_a", "1,0.5\n2,0.7\n3,0.7\n"), ("sweep_b", "1,x\n2,0.6\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.csv").write_text("  epoch,  metrics/mAP50-95(B)\n" + rows)
    m = files.run_metrics(spark, str(tmp_path / "sweep_*" / "results.csv"))
    got = dataset.best_epochs(m, "run", "epoch", "metric", "row").collect()
    assert [(r.run, r.metric, r.epoch) for r in got] == [("sweep_a", 0.7, "2"), ("sweep_b", 0.6, "2")]


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([{f: f for f in dataset.V.FIELDS} | {"doc_id": "1"}]).withColumn("checks", F.lit("c"))
    edit = spark.createDataFrame([("1", "total", "9.99")], "doc_id string, field string, value string")
    assert '"total":"9.99"' in sinks.export_envelope(rec, overrides=edit).first().json
    lab = spark.createDataFrame([("train", "a", 1, "1 x"), ("val", "b", 0, None)], "split string, image string, class_id int, line string")
    sinks.label_files(lab, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() >= 1
    assert "  0: invoice_type" in sinks.dataset_yaml("/d")


def test_stream_goes_on_after_what_it_read(spark, tmp_path):
    drop, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("发票号码:12345678\n", encoding="utf8")
    ingest.write(ingest.parsed(ingest.invoice_stream(spark, drop)), out, state).awaitTermination()
    (tmp_path / "in/b.txt").write_text("发票号码:87654321\n", encoding="utf8")
    ingest.write(ingest.parsed(ingest.invoice_stream(spark, drop)), out, state).awaitTermination()
    assert sorted(r.invoice_no for r in spark.read.parquet(out).collect()) == ["12345678", "87654321"]
