"""Target-distribution importance resampling by hashed n-grams.

Words get their places by posexplode; for each order above one, lead() over a
document's words joins those that follow.  Every n-gram falls in one of a fixed
number of buckets.  What the target says of a bucket against what the raw corpus
says of it is the bucket's gain; a document's weight is the sum of its gains.
Documents are drawn without replacement by the largest weights plus Gumbel
noise, which comes from a hash of the doc_id.

Counts of buckets are summed in each task before they move, and so are a
document's gains, which are found in a table of as many rows as there are
buckets.  Ranks are given within bins of the score, whose bounds are
percentiles of the scores; each bin starts after the rows of those above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.llm.state import Scratch

#: What is between words once A to Z are small letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
#: Rows of a bin are ranked in one task; so many bins a shuffle partition.
BINS = 4


def words(text: Column) -> Column:
    """Words of a text in order; one empty piece may stand before them and one after."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), GAP, -1)


def features(docs: DataFrame, orders: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(__row, order, bucket, and the columns ``keep``): each run of 1 to ``orders`` words of each row.

    A row without words has one entry, whose order and bucket are null.
    ``__row`` tells equal rows apart.
    """
    own = ("__row", *keep)
    rows = docs.select(*keep, "text").withColumn("__row", F.monotonically_increasing_id())
    placed = rows.select(*own, F.posexplode_outer(F.filter(words(F.col("text")), lambda w: w != "")).alias("place", "w1"))
    following = Window.partitionBy("__row").orderBy("place")
    for k in range(2, orders + 1):
        placed = placed.withColumn(f"w{k}", F.concat(F.col(f"w{k - 1}"), F.lit(" "), F.lead("w1", k - 1).over(following)))
    if orders == 1:
        gram = placed.select(*own, F.when(F.col("w1").isNotNull(), 1).alias("order"), F.col("w1").alias("gram"))
    else:
        made = F.array(*[F.struct(F.lit(k).alias("order"), F.col(f"w{k}").alias("gram")) for k in range(1, orders + 1)])
        runs = F.filter(made, lambda x: x["gram"].isNotNull())
        gram = placed.select(*own, F.explode_outer(runs).alias("x")).select(*own, "x.order", "x.gram")
    return gram.select(*own, "order", (F.crc32("gram") % buckets).cast("int").alias("bucket"))


def bucket_counts(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    return features(docs, orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor of 1000 times the logarithm of target over raw share, each count one up."""
    raw, wanted = bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets)
    both = raw.withColumnRenamed("n", "s").unionByName(wanted.withColumnRenamed("n", "t"), allowMissingColumns=True)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = both.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))
    s, t, ss, tt = (F.col(c).cast("double") for c in ("s", "t", "ss", "tt"))
    ratio = (t + 1) * (ss + buckets) / ((s + 1) * (tt + buckets))
    return both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: str, seed: int) -> Column:
    """1000 times Gumbel noise, as a whole number; a null doc_id counts as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, table: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``; without words all are 0."""
    found = features(docs, orders, buckets, ("doc_id",)).join(F.broadcast(table), "bucket", "left")
    summed = found.groupBy("__row", "doc_id").agg(F.count_if(F.col("order") == 1).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.drop("__row")


def with_rank(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Adds rank, 1 upwards by (score descending, doc_id), to the best ``percent`` of the eligible rows, null to all others.

    ``scored`` is read several times.  Ties beyond doc_id are of rows that
    differ in nothing that is returned; a null doc_id comes last among equals.
    Bins can't be finer than one score, of which noise of unlike doc_ids
    leaves one row in 2,700 at most.
    """
    spark = scored.sparkSession
    bins = BINS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = scored.where(eligible)
    at = some.agg(F.percentile_approx("score", [k / bins for k in range(1, bins)], 10 * bins).alias("at"), F.count(F.lit(1)).alias("n")).collect()[0]
    draw = at.n * percent // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    bounds = sorted(set(at["at"]), reverse=True)
    # a bin holds the scores from its bound up to, and without, the bound before it
    bin_of = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b > F.col("score")))
    marked = scored.withColumn("bin", F.when(eligible, bin_of))
    counts = {r.bin: r.n for r in marked.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = [], 0
    for b in range(len(bounds) + 1):
        before.append(start)
        start += counts.get(b, 0)
    offset = F.get(F.lit(before).cast("array<long>"), F.col("bin"))
    inside = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    reached = F.col("bin").isNotNull() & (offset < draw)
    ranked = marked.where(reached).withColumn("rank", offset + inside)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    others = marked.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("bin")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, orders: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``.

    Drawn are the ``percent`` of the rows with at least ``least_words`` words
    that score best, ties to the smaller doc_id; their rank starts at 1, that
    of the others is null.  A null text is empty: no features, weight 0.
    Equal rows are rows of their own.  An empty target or an empty ``docs``
    gives gains from the raw counts alone, or no rows.  Other columns are left
    aside.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    table = scratch.keep(gains(docs, target, orders, buckets))
    scored = weigh(docs, table, orders, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = scratch.keep(scored)
    scratch.drop(table)
    return with_rank(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    # CRC-32 as a fold over UTF-8 bytes; its 256 remainders follow from the polynomial by eight shifts
    return rf"""WITH RECURSIVE shifts(b, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT b, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM shifts WHERE k < 8),
  rest AS (SELECT list(c ORDER BY b) AS l FROM shifts WHERE k = 8),
  runs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
  wanted AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
  each AS (SELECT doc_id, unnest(ws) AS w FROM runs),
  per AS (SELECT doc_id, w, count(*) AS n FROM each GROUP BY ALL),
  named AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(hex(encode(w))), 2), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(i AS INTEGER), 2) AS BIGINT))),
      lambda c, b: xor(l[CAST(xor(c & 255, b) AS INTEGER) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT w FROM per UNION SELECT w FROM wanted), rest),
  s AS (SELECT bucket, sum(n) AS s FROM per JOIN named USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN named USING (w) GROUP BY ALL),
  sums AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM s) AS DOUBLE) AS ss, CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) AS tt),
  gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), sums),
  weighed AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM per JOIN named USING (w) JOIN gain USING (bucket) GROUP BY ALL),
  scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM runs LEFT JOIN weighed USING (doc_id)),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
