"""Invoice texts rendered from the order tables, one an order, in six regimes.

0 all labels; 1 special invoice, full-width signs; 2 no amount and tax
labels; 3 issued by an agent; 4 no buyer id; 5 total off by three cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.functions import text as T

DRAWERS = ("王小明", "李芳", "欧阳明", "诸葛亮")

#: The same facts for the SQL side.
BASE_SQL = """base AS (
  SELECT k, cust, supp, d, amount_c, tax_c, amount_c + tax_c AS total_c, k % 6 AS r,
    '1' || lpad(CAST(k AS VARCHAR), 7, '0') AS invoice_no, '1100' || lpad(CAST(k AS VARCHAR), 8, '0') AS invoice_code,
    strftime(d, '%Y年%m月%d日') AS invoice_date, '客户' || cust || '有限公司' AS buyer_name, '供应商' || supp || '有限公司' AS seller_name,
    '91' || lpad(CAST(cust AS VARCHAR), 15, '0') || 'X' AS buyer_tax_id, '92' || lpad(CAST(supp AS VARCHAR), 15, '0') || 'Y' AS seller_tax_id,
    CASE k % 4 WHEN 0 THEN '王小明' WHEN 1 THEN '李芳' WHEN 2 THEN '欧阳明' ELSE '诸葛亮' END AS drawer
  FROM (SELECT o_orderkey AS k, any_value(o_custkey) AS cust, min(l_suppkey) AS supp, any_value(o_orderdate) AS d,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount_c,
      CAST(sum((CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50) // 100) AS BIGINT) AS tax_c
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey))"""
MONEY_SQL = "(CAST(({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(({0}) % 100 AS VARCHAR), 2, '0'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: the values that its invoice shows."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", price.alias("p"), F.round(F.col("l_tax") * 100).cast("bigint").alias("pct"))
    sums = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp"), F.sum("p").alias("amount_c"), F.sum(F.expr("(p * pct + 50) div 100")).alias("tax_c"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    key, cust, supp = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "supp"))
    return joined.select(
        F.col("o_orderkey").alias("doc_id"),
        (F.col("o_orderkey") % 6).alias("r"),
        "amount_c",
        "tax_c",
        (F.col("amount_c") + F.col("tax_c")).alias("total_c"),
        F.concat(F.lit("1"), F.lpad(key, 7, "0")).alias("f_no"),
        F.concat(F.lit("1100"), F.lpad(key, 8, "0")).alias("f_code"),
        F.date_format("o_orderdate", "yyyy年MM月dd日").alias("f_date"),
        F.concat(F.lit("客户"), cust, F.lit("有限公司")).alias("f_buyer"),
        F.concat(F.lit("供应商"), supp, F.lit("有限公司")).alias("f_seller"),
        F.concat(F.lit("91"), F.lpad(cust, 15, "0"), F.lit("X")).alias("f_buyer_id"),
        F.concat(F.lit("92"), F.lpad(supp, 15, "0"), F.lit("Y")).alias("f_seller_id"),
        F.get(F.array(*map(F.lit, DRAWERS)), (F.col("o_orderkey") % 4).cast("int")).alias("f_drawer"),
    )


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, since parsing costs far more than reading.

    By doc_id itself the deal would equal the partitioning of the join before,
    be left out, and the join's small output be made one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, r, text)"""
    return dealt(facts(spark, sf_dir)).select("doc_id", "r", invoice_text().alias("text"))


def invoice_text() -> Column:
    """The text of an invoice from its facts."""
    r = F.col("r")
    amount, tax = T.money(F.col("amount_c")), T.money(F.col("tax_c"))
    total = T.money(F.when(r == 5, F.col("total_c") + 3).otherwise(F.col("total_c")))
    rows = [
        F.when(r == 1, "增值税专用发票").otherwise("增值税普通发票"),
        F.concat(F.lit("发票代码:"), F.col("f_code")),
        F.concat(F.lit("发票号码:"), F.col("f_no")),
        F.concat(F.lit("开票日期:"), F.col("f_date")),
        F.concat(F.lit("校验码:"), F.lpad(F.col("f_no"), 20, "7")),
        F.concat(F.lit("购买方名称:"), F.col("f_buyer")),
        F.when(r != 4, F.concat(F.lit("纳税人识别号:"), F.col("f_buyer_id"))),
        F.lit("货物或应税劳务"),
        F.when(r == 2, amount).otherwise(F.concat(F.lit("金额 ¥"), amount)),
        F.when(r == 2, tax).otherwise(F.concat(F.lit("税额 ¥"), tax)),
        F.concat(F.lit("价税合计(小写) ¥"), total),
        F.concat(F.lit("销售方名称:"), F.when(r == 3, "某市税务局").otherwise(F.col("f_seller"))),
        F.when(r != 3, F.concat(F.lit("纳税人识别号:"), F.col("f_seller_id"))),
        F.when(r == 3, F.concat(F.lit("代开企业税号:"), F.col("f_seller_id"))),
        F.when(r == 3, F.concat(F.lit("代开企业名称:"), F.col("f_seller"))),
        F.concat(F.lit("开票人:"), F.col("f_drawer")),
    ]
    text = F.concat_ws("\n", *rows)
    wide = F.translate(F.replace(text, F.lit(":"), F.lit(": ")), ":¥", "：￥")
    return F.when(r == 1, wide).otherwise(text)


def page_lines(text: Column, doc_id: Column) -> Column:
    """A text as an array of lines with boxes, forty pixels apart, amount and tax on one row."""

    def line(t: Column, k: Column) -> Column:
        tax_row = F.contains(t, F.lit("税额"))
        y = (F.when(tax_row, k - 1).otherwise(k) * 40).cast("double")
        x = F.when(tax_row, 500.0).otherwise(100.0)
        return F.struct(y.alias("y1"), x.alias("x1"), k.alias("line_no"), t.alias("text"), (90 + doc_id % 10).cast("double").alias("score"), (x + 200).alias("x2"), (y + 20).alias("y2"))

    return F.transform(F.split(text, "\n"), line)


def page_crops() -> Column:
    """A detector's crops of an invoice: every field, decoys, a stamp, a crop without text and one of no field.

    On every seventh invoice the detector takes amount and tax for each other.
    """
    k = F.col("doc_id")
    swapped = k % 7 == 0
    amount, tax = (F.concat(F.lit(" :¥"), T.money(F.col(c)), F.lit("；")) for c in ("amount_c", "tax_c"))
    made = [
        ("invoice_type", 90, 100, 10, F.when(F.col("r") == 1, "增值税专用发票").otherwise("增值税普通发票")),
        ("invoice_code", 90, 100, 40, F.col("f_code")),
        ("invoice_no", 90, 500, 40, F.col("f_no")),
        ("invoice_date", 90, 500, 80, F.col("f_date")),
        ("checksum", 90, 100, 80, F.lpad(F.col("f_no"), 20, "7")),
        ("buyer_name", 90, 100, 120, F.col("f_buyer")),
        ("buyer_tax_id", 90, 100, 160, F.col("f_buyer_id")),
        ("amount", 99, 300, 200, F.lit("¥1.00")),
        (F.when(swapped, "tax").otherwise("amount"), 80, 300, 440, amount),
        (F.when(swapped, "amount").otherwise("tax"), 80, 500, 440, tax),
        ("total", 90, 300, 480, F.concat(F.lit("¥"), T.money(F.col("total_c")))),
        ("seller_name", 99, 100, 540, F.lit("某某发票专用章")),
        ("seller_name", 70, 100, 520, F.col("f_seller")),
        ("seller_tax_id", 99, 100, 500, F.lit("账号")),
        ("seller_tax_id", 70, 100, 560, F.col("f_seller_id")),
        ("drawer", 90, 100, 600, F.col("f_drawer")),
        ("remark", 90, 600, 600, F.lit(" ：|")),
        ("stamp", 90, 600, 20, F.lit("样张，")),
    ]
    crop = lambda n, field, confidence, x, y, text: F.struct(F.lit(n).alias("det_no"), (F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(float(confidence)).alias("confidence"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + 150).alias("x2"), F.lit(y + 24).alias("y2"), text.alias("text"), F.lit(80.0 + n % 3).alias("ocr_confidence"))
    return F.array(*[crop(n, *m) for n, m in enumerate(made)])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ``recognise`` takes them, with r; every way that a page can go."""
    f = dealt(facts(spark, sf_dir)).withColumn("text", invoice_text())
    k = F.col("doc_id")
    nth = F.floor(k / 6) % 6
    return f.select(
        "doc_id",
        "r",
        F.when(nth == 0, "off").when(nth.isin(1, 3), "auto").when(nth.isin(2, 5), "force").alias("mode"),
        F.when(nth == 4, F.col("text")).alias("pdf_text"),
        F.col("text").alias("ocr_text"),
        F.lit(88.5).alias("ocr_confidence"),
        F.when((nth == 3) | ((nth == 5) & (k % 5 == 0)), "no model").alias("detector_error"),
        page_lines(F.col("text"), k).alias("lines"),
        page_crops().alias("crops"),
    )
