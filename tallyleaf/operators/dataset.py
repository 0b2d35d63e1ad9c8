"""Dataset building: label files, annotation links, splits, counts, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyleaf.functions import values as V
from tallyleaf.operators.shared import kept

# Question texts (with their misreadings) to classes.
QUESTIONS = {
    "No": "invoice_no",
    "开票日期": "invoice_date",
    "开票日期：": "invoice_date",
    "开叠日期：": "invoice_date",
    "开日期": "invoice_date",
    "名称": "buyer_name",
    "名称：": "buyer_name",
    "纳税人识别号": "buyer_tax_id",
    "纳税人识别号：": "buyer_tax_id",
    "金额": "amount",
    "金颈": "amount",
    "金镇": "amount",
    "全领": "amount",
    "税额": "tax",
    "税颜": "tax",
    "税领": "tax",
    "税颈": "tax",
    "价税合计": "total",
}
NODES = "array<struct<id:int,transcription:string,label:string,linking:array<array<int>>,points:array<array<double>>>>"


def label_line(class_id: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """'class cx cy w h', six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)


def clipped_line(class_id: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """As label_line, cut to the image; null if a side is under two pixels."""
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(most - 1.0, v))
    a, b, c, d = cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)
    return F.when((c - a >= 2) & (d - b >= 2), label_line(class_id, a, b, c, d, width, height))


def box_of(points: Column) -> list[Column]:
    """x1, y1, x2, y2 around a polygon."""
    # a second parameter of the lambda would be the point's number
    side = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    xs, ys = side(0), side(1)
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def parse_labels(df: DataFrame, value: str = "value") -> DataFrame:
    """Class and box of label lines; lines that are short, not numeric or flat are left out."""
    t = F.split(F.trim(F.col(value)), "\\s+")
    num = [F.try_element_at(t, F.lit(k)).try_cast("double") for k in range(1, 6)]
    keep = [c for c in df.columns if c != value]
    out = df.select(*keep, *[n.alias(x) for n, x in zip(num, ("cls", "cx", "cy", "w", "h"), strict=True)])
    return out.where("cls is not null and cx is not null and cy is not null and w > 0 and h > 0").withColumn("cls", F.col("cls").cast("int"))


def corners(df: DataFrame, width: Column, height: Column) -> DataFrame:
    half = lambda c, s, sign, size: (F.col(c) + sign * F.col(s) / 2) * size
    return df.withColumns({"x1": half("cx", "w", -1, width), "y1": half("cy", "h", -1, height), "x2": half("cx", "w", 1, width), "y2": half("cy", "h", 1, height)})


def parse_annotations(df: DataFrame, value: str = "value") -> DataFrame:
    """(image, nodes) of tab-separated annotation lines."""
    parts = F.split(F.col(value), "\t", 2)
    return df.select(F.get(parts, F.lit(0)).alias("image"), F.from_json(F.get(parts, F.lit(1)), NODES).alias("nodes"))


def linked_pairs(nodes: DataFrame) -> DataFrame:
    """Question and answer nodes that a question links: (image, node_no, link_no, question, answer).

    The nodes of an image, even of several lines, come together once; links are followed in the row.
    """
    rows = nodes.where("image is not null").select("image", F.posexplode("nodes").alias("node_no", "n")).where("n.label in ('question', 'answer')")
    own = rows.groupBy("image").agg(F.collect_list(F.struct("node_no", "n")).alias("own"))
    labelled = lambda label: F.filter("own", lambda x: x["n"]["label"] == label)
    own = own.select("image", labelled("question").alias("questions"), labelled("answer").alias("answers"))
    # of several answers with the number that a link names the last one counts
    named = lambda k: F.array_max(F.transform(F.filter("answers", lambda a: a["n"]["id"] == k), lambda a: F.struct(a["node_no"].alias("node_no"), a["n"].alias("n"))))["n"]

    def links(q: Column) -> Column:
        met = lambda link: F.when((F.size(link) == 2) & (F.get(link, F.lit(0)) == q["n"]["id"]), named(F.get(link, F.lit(1))))
        made = F.transform(q["n"]["linking"], lambda link, k: F.struct(q["node_no"].alias("node_no"), k.alias("link_no"), q["n"].alias("question"), met(link).alias("answer")))
        return F.filter(made, lambda m: m["answer"].isNotNull())

    met = F.filter(F.transform("questions", links), lambda m: m.isNotNull())
    return own.select("image", F.inline(F.flatten(met)))


def convert(nodes: DataFrame, width: Column, height: Column) -> DataFrame:
    """(image, class, text, line): the first answer of each class as a label line."""
    table = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    size = [c for c in ("width", "height") if c in nodes.columns]
    pairs = linked_pairs(nodes)
    pairs = pairs.join(nodes.select("image", *size), "image") if size else pairs
    pairs = pairs.withColumn("class", F.try_element_at(table, F.trim("question.transcription"))).where("class is not null")
    w = Window.partitionBy("image", "class").orderBy("node_no", "link_no")
    one = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    cls = F.array_position(F.array(*map(F.lit, V.CLASSES)), F.col("class")).cast("int") - 1
    return one.select("image", "class", F.trim("answer.transcription").alias("text"), clipped_line(cls, *box_of(F.col("answer.points")), width, height).alias("line"))


def split_by_place(df: DataFrame, key: str, share: float) -> DataFrame:
    """Adds split: the last ``share`` of the rows by key is 'val', none of a single row.

    Places come from counts by range of the key, so no task numbers all rows.
    """
    n = df.count()
    cut = int(n * (1 - share)) if n > 1 and share > 0 else n
    placed = numbered(df, key)
    return placed.withColumn("split", F.when(F.col("place") >= cut, "val").otherwise("train"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``place`` (from 0) in the order of a key that is unique.

    Which range a row falls in rests on a sample, so it is written down once,
    before rows are counted by range and numbered.
    """
    ranged = kept(df.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(key)
    inside = ranged.withColumn("_k", F.row_number().over(w))
    sizes = inside.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"), F.min(key).alias("_low"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_p", "_k", "_before")


def replicate(spark: SparkSession, df: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` samples, sample i from row i modulo the number of rows."""
    n = df.count()
    samples = spark.range(count).select(F.col("id").alias("sample"), F.pmod("id", F.lit(max(n, 1))).alias("place"))
    return samples.join(numbered(df, key), "place")


def without_existing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def class_counts(df: DataFrame, image: str, cls: str) -> DataFrame:
    """(class, images): in how many images each class is, zeros kept."""
    every = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(V.CLASSES)], "class string, class_id int")
    found = df.groupBy(F.col(cls).alias("class")).agg(F.countDistinct(image).alias("n"))
    return every.join(found, "class", "left").select("class", "class_id", F.coalesce("n", F.lit(0)).alias("images"))


def totals(df: DataFrame, image: str, cls: str) -> DataFrame:
    """One row: images, boxes, and the class names that occur, sorted."""
    return df.agg(F.countDistinct(image).alias("images"), F.count(F.lit(1)).alias("boxes"), F.sort_array(F.collect_set(cls)).alias("classes"))


def gate(paths: DataFrame, path: str, images: int, labels: int, bad_files: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of images, label files and stray files among the labels, and whether they are exactly the expected ones.

    One row, or one for each group of the columns ``by``.  A stray file in
    labels/train or labels/val is a label file too.  No files at all are 0, 0, 0.
    """
    p = F.col(path)
    image = p.rlike("(?i)(?:^|/)images/.*\\.(?:jpg|jpeg|png)$")
    stray = p.rlike("(?:^|/)labels/(?:.*/)?(?:label|classes)\\.txt$")
    label = p.rlike("(?:^|/)labels/(?:train|val)/.*\\.txt$")
    n = paths.groupBy(*by).agg(F.count_if(image).alias("images"), F.count_if(label).alias("labels"), F.count_if(stray).alias("bad_files"))
    return n.withColumn("ok", (F.col("images") == images) & (F.col("labels") == labels) & (F.col("bad_files") == bad_files))


def choose_samples(files: DataFrame, there: DataFrame, prefer: str, limit: int, offset: int = 0) -> DataFrame:
    """(name, place): new file names, those of the preferred prefix first, then by name, ``limit`` after ``offset``."""
    new = without_existing(files.select("name").distinct(), there, "name")
    ordered = new.orderBy(F.when(F.col("name").startswith(f"{prefer}_"), 0).otherwise(1), "name").offset(offset).limit(limit)
    w = Window.orderBy(F.when(F.col("name").startswith(f"{prefer}_"), 0).otherwise(1), "name")
    return ordered.withColumn("place", F.row_number().over(w).cast("bigint") + offset)


def missing_classes(present: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, V.CLASSES)), present)


def metric_column(columns: list[str]) -> str | None:
    """The first column whose name speaks of mAP50-95."""
    return next((c for c in columns if any(x in c.strip().lower() for x in ("map50-95", "map50_95"))), None)


def best_epochs(metrics: DataFrame, run: str, epoch: str, metric: str, row: str) -> DataFrame:
    """For each run its best metric and the first epoch that reached it; values that are no numbers are passed over."""
    m = metrics.withColumn("_m", F.col(metric).cast("string").try_cast("double")).where("_m is not null")
    best = m.groupBy(run).agg(F.max(F.struct("_m", (-F.col(row)).alias("r"), F.col(epoch).alias("e"))).alias("b"))
    return best.select(run, F.col("b._m").alias("metric"), F.col("b.e").alias("epoch")).orderBy(F.desc("metric"), F.desc(F.col("epoch").cast("string")), F.desc(run))
