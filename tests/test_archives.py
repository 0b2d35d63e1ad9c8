import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyleaf.sources import archives


def archive(path, names):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("r")
        for k, n in enumerate(names):
            z.writestr(n, f"content {k}")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    archive(tmp_path / "a.zip", [f"r/dataset/images/{'vat' if k % 3 else 'taxi'}_{k:03}.{'jpg' if k % 4 else 'PNG'}" for k in range(60)] + ["r/other/vat_1.jpg", "r/dataset/images/._vat_2.jpg", "r/dataset/images/vat_3.txt"])
    archive(tmp_path / "deep/b.ZIP", ["s/dataset/images/x/vat_001.jpg", "s/dataset/images/vat_900.jpg"])
    (tmp_path / "broken.zip").write_bytes(b"no archive" * 10)
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_entries_in_ranges(spark, folder):
    all_ = archives.entries(spark, folder, per_task=7)
    assert all_.rdd.getNumPartitions() == 12  # 64 entries in ten ranges, three in one, and the broken archive
    rows = all_.collect()
    assert sum(r.name is not None for r in rows) == 65
    assert [(os.path.basename(r.path), r.error.split(":")[0]) for r in rows if r.error] == [("broken.zip", "BadZipFile")]
    assert all(r.content is None for r in rows)
    full = archives.entries(spark, folder, per_task=10, content=True).where("name like '%taxi_009%'").first()
    assert bytes(full.content) == b"content 9" and full.size == 9
    assert archives.entries(spark, os.path.join(folder, "a.zip")).count() == 63


def test_images_and_samples(spark, folder):
    listing = archives.entries(spark, folder, per_task=9)
    assert archives.images(listing).count() == 62
    there = spark.createDataFrame([("vat_002.jpg",), ("taxi_000.PNG",)], "name string")
    got = archives.with_content(archives.samples(listing, there, "vat", 5, 1)).orderBy("place").collect()
    # vat_001.jpg comes first and is passed over by the offset; its copy in the other archive isn't a second one
    assert [r.file for r in got] == ["vat_004.PNG", "vat_005.jpg", "vat_007.jpg", "vat_008.PNG", "vat_010.jpg"]
    assert [bytes(r.content) for r in got] == [b"content 4", b"content 5", b"content 7", b"content 8", b"content 10"]
    assert {r.place for r in got} == {2, 3, 4, 5, 6}
    every = archives.samples(listing, there, "vat", 1000).collect()
    assert len(every) == 59 and len({r.file for r in every}) == 59


def test_damaged_entry(spark, tmp_path):
    p = tmp_path / "c.zip"
    archive(p, ["r/dataset/images/vat_1.jpg", "r/dataset/images/vat_2.jpg"])
    data = bytearray(p.read_bytes())
    at = data.index(b"vat_1.jpg") + len(b"vat_1.jpg")
    data[at : at + 4] = b"\xff\xff\xff\xff"
    p.write_bytes(data)
    rows = archives.with_content(archives.images(archives.entries(spark, str(p)))).orderBy("name").collect()
    assert rows[0].error and rows[0].content is None and bytes(rows[1].content) == b"content 1"


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_dataset_is_whole_or_absent(spark, tmp_path):
    to = str(tmp_path / "set")
    df = spark.range(0, 40, numPartitions=5).select(F.format_string("images/%s/%d.jpg", F.when(F.col("id") % 4 == 0, "val").otherwise("train"), "id").alias("file"), F.col("id").cast("string").cast("binary").alias("content"))
    archives.write_dataset(df, to)
    assert len(tree(to)) == 41 and os.listdir(tmp_path) == ["set"]
    assert open(os.path.join(to, "files.csv")).read() == "split,files\ntrain,30\nval,10\n"
    assert open(os.path.join(to, "images/val/8.jpg")).read() == "8"
    with pytest.raises(Exception, match="exists"):
        archives.write_dataset(df, to)
    # a task that fails leaves what was there, and nothing beside it
    bad = df.withColumn("file", F.when(F.col("file").contains("/33."), "images/../33.jpg").otherwise(F.col("file")))
    for wrong in (bad, df.unionByName(df.limit(1))):
        with pytest.raises(Exception, match="33|two rows"):
            archives.write_dataset(wrong, to, overwrite=True)
        assert len(tree(to)) == 41 and os.listdir(tmp_path) == ["set"]
        with pytest.raises(Exception, match="33|two rows"):
            archives.write_dataset(wrong, str(tmp_path / "new"))
        assert os.listdir(tmp_path) == ["set"]
    archives.write_dataset(df.where("file like '%val%'"), to, overwrite=True)
    assert len(tree(to)) == 11 and os.listdir(tmp_path) == ["set"]
