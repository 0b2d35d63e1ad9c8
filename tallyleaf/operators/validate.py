"""Validation of records: a level and a message for each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.functions import values as V

# Messages.
OK, MISSING, OPTIONAL, ABSENT = "正常", "缺失", "可为空", "票面未提供"
BAD_TAX_ID, BAD_NUMBER, BAD_DATE = "需确认：税号格式异常", "需确认：发票号码格式异常", "需确认：日期格式异常"
SUM_OK, SUM_BAD = "金额关系正常", "需确认：金额 + 税额 不等于价税合计"


def level(name: str, message: str) -> Column:
    return F.struct(F.lit(name).alias("level"), F.lit(message).alias("message"))


def tax_id(c: Column) -> Column:
    good = F.char_length(c).between(15, 20) & c.rlike("(?U)\\p{Nd}") & c.rlike("\\p{L}")
    return F.when(c == "", level("warning", MISSING)).when(good, level("ok", OK)).otherwise(level("warning", BAD_TAX_ID))


def checks() -> dict[str, Column]:
    """A check for each field of a record; null fields read as empty."""
    c = {f: F.coalesce(F.col(f), F.lit("")) for f in V.FIELDS}
    out = {f: F.when(c[f] != "", level("ok", OK)).otherwise(level("missing", MISSING) if f in V.REQUIRED else level("optional", OPTIONAL)) for f in V.FIELDS}
    plain = F.contains(c["invoice_type"], F.lit("普通发票"))
    out["buyer_tax_id"] = F.when((c["buyer_tax_id"] == "") & plain, level("optional", ABSENT)).otherwise(tax_id(c["buyer_tax_id"]))
    out["seller_tax_id"] = tax_id(c["seller_tax_id"])
    out["invoice_no"] = F.when(c["invoice_no"] == "", out["invoice_no"]).when(c["invoice_no"].rlike("\\A(?U)\\d{8,20}\\z"), level("ok", OK)).otherwise(level("warning", BAD_NUMBER))
    out["invoice_date"] = F.when(c["invoice_date"] == "", out["invoice_date"]).when(c["invoice_date"].rlike("\\A20[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日\\z"), level("ok", OK)).otherwise(level("warning", BAD_DATE))
    total, amount, tax = (T.cents(c[f]) for f in ("total", "amount", "tax"))
    gap = F.abs(amount + tax - total)
    for f in ("total", "amount", "tax"):
        out[f] = F.when(gap <= 2, level("ok", SUM_OK)).when(gap > 2, level("warning", SUM_BAD)).otherwise(out[f])
    return out


def validate(df: DataFrame) -> DataFrame:
    """All columns and ``checks``, a struct of (level, message) by field."""
    return df.withColumn("checks", F.struct(*[v.alias(f) for f, v in checks().items()]))


def long_checks(df: DataFrame, key: str) -> DataFrame:
    """(key, field, level, message), thirteen rows a record."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"checks.{f}.level").alias("level"), F.col(f"checks.{f}.message").alias("message")) for f in V.FIELDS])
    return validate(df).select(key, F.inline(each))


LEVELS = ("ok", "warning", "optional", "missing")


def level_counts(df: DataFrame) -> DataFrame:
    """(field, level, n): how many records have which level, in one pass without a row for each check."""
    levels = validate(df).select(*[F.col(f"checks.{f}.level").alias(f) for f in V.FIELDS])
    one = levels.agg(*[F.count_if(F.col(f) == v).alias(f"{f}_{v}") for f in V.FIELDS for v in LEVELS])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("level"), F.col(f"{f}_{v}").alias("n")) for f in V.FIELDS for v in LEVELS])
    return one.select(F.inline(rows)).where("n > 0")
