"""Text to the 13-field record: primary patterns, the values at a text's tail, fallbacks and overrides.

The steps are projections over earlier columns in a fixed order, which is
part of the meaning: each reads what the ones before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import extract as X
from tallyleaf.functions import text as T
from tallyleaf.functions import values as V


def fill(current: Column, value: Column) -> Column:
    return F.when(current == "", F.coalesce(value, F.lit(""))).otherwise(current)


def primary(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm and the fields by primary pattern."""
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("norm", T.normalize(F.col(text)))
    df = df.withColumns({f: X.first_match(F.col("norm"), V.PRIMARY[f]) for f in V.FIELDS})
    return df.withColumn("invoice_type", X.invoice_type(F.col("invoice_type"), F.col("norm")))


def tail_values(df: DataFrame, text: str = "text", lines: Column | None = None) -> DataFrame:
    """Fills fields from the values that follow the last 开票人 label (texts of electronic invoices).

    ``lines`` are the text's cleaned lines, where they have been made before.
    """
    df = df.withColumn("_lines", T.nonempty(F.col(text)) if lines is None else lines)
    last = F.array_max(F.transform(F.col("_lines"), lambda x, k: F.when(F.contains(x, F.lit("开票人")), k + 1).otherwise(0)))
    df = df.withColumn("_last", F.coalesce(last, F.lit(0)))
    df = df.withColumn("_tail", F.when(F.col("_last") > 0, F.transform(F.slice("_lines", F.col("_last") + 1, F.greatest(F.size("_lines"), F.lit(1))), T.normalize)).otherwise(F.array().cast("array<string>")))
    t = F.col("_tail")
    solid = lambda x: F.concat(F.substring(x, 1, 4), F.lit("年"), F.substring(x, 5, 2), F.lit("月"), F.substring(x, 7, 2), F.lit("日"))
    is_id = lambda x: x.rlike("\\A[0-9A-Z]{15,20}\\z") & x.rlike("[A-Z]")
    money = F.flatten(F.transform(t, X.money_candidates))
    df = df.withColumns(
        {
            "_ids": F.filter(t, is_id),
            "_last_firms": F.filter(t, lambda x: x.rlike("(?:公司|税务局|合作社|商店|中心|厂|部)$")),
            "_days": F.transform(F.filter(t, X.is_day), lambda x: F.when(x.rlike("\\A20[0-9]{6}\\z"), solid(x)).otherwise(x)),
            "_numbers": F.filter(t, lambda x: x.rlike("\\A[0-9]{16,20}\\z")),
            "_people": F.filter(t, lambda x: T.is_person(x) & ~x.rlike("客车|不征税")),
            "_cents": F.array_sort(F.array_distinct(F.transform(money, T.cents))),
            "_drawer": X.drawer_in_tail(t),
        }
    )

    def firm_after(k: int) -> Column:
        own = F.get("_ids", F.lit(k))
        near = F.transform(t, lambda x, i: F.when(x == own, T.first(F.filter(F.slice(t, i + 2, F.lit(3)), T.is_company))).otherwise(""))
        return F.when((F.lit(k) == 0) | (own != F.get("_ids", F.lit(0))), T.first(X.nonblank(near))).otherwise("")

    ids, firms, c = F.col("_ids"), F.col("_last_firms"), F.col("_cents")
    df = df.withColumns(
        {
            "buyer_tax_id": fill(F.col("buyer_tax_id"), F.get(ids, F.lit(0))),
            "seller_tax_id": fill(F.col("seller_tax_id"), F.get(ids, F.lit(1))),
            "buyer_name": fill(fill(F.col("buyer_name"), firm_after(0)), F.get(firms, F.lit(0))),
            "seller_name": fill(fill(F.col("seller_name"), firm_after(1)), F.when(F.size(firms) > 1, F.get(firms, F.size(firms) - 1))),
            "invoice_no": fill(F.col("invoice_no"), F.get("_numbers", F.lit(0))),
            "invoice_date": fill(F.col("invoice_date"), F.get("_days", F.lit(0))),
        }
    )
    down = F.reverse(c)
    sums = F.flatten(F.transform(down, lambda total: F.transform(F.filter(down, lambda a: (a < total) & F.array_contains(c, total - a) & (total - a <= a)), lambda a: F.struct(total.alias("total"), a.alias("amount")))))
    untaxed = F.contains(F.col(text), F.lit("不征税")) | F.contains(F.col(text), F.lit("\n*\n"))
    df = df.withColumns({"_sum": F.get(sums, F.lit(0)), "_untaxed": untaxed, "_most": F.array_max(c)})
    some = F.size("_cents") > 0
    take = lambda plain, free: F.when(some & F.col("_untaxed"), free).when(some, plain)
    df = df.withColumns(
        {
            "total": fill(F.col("total"), take(F.coalesce(T.money(F.col("_sum")["total"]), T.money(F.col("_most"))), T.money(F.col("_most")))),
            "amount": fill(F.col("amount"), take(T.money(F.col("_sum")["amount"]), T.money(F.col("_most")))),
            "tax": fill(F.col("tax"), take(T.money(F.col("_sum")["total"] - F.col("_sum")["amount"]), F.lit("0.00"))),
            "drawer": F.when(F.col("_drawer") != "", F.col("_drawer")).otherwise(fill(F.col("drawer"), F.get("_people", F.lit(0)))),
        }
    )
    return df.drop("_lines", "_last", "_tail", "_ids", "_last_firms", "_days", "_numbers", "_people", "_cents", "_drawer", "_sum", "_untaxed", "_most")


def parse(df: DataFrame, text: str = "text") -> DataFrame:
    """The record of every row: all columns of ``df`` and the 13 fields ('' where missing)."""
    keep = [c for c in df.columns if c not in V.FIELDS]
    raw, norm = F.col(text), F.col("norm")
    df = primary(df.select(*keep), text).withColumn("_all", T.clean_lines(raw))
    df = df.withColumns({"_clean": X.nonblank(F.col("_all")), "_kept": X.kept_of(raw, norm, F.col("_all"))}).drop("_all")
    df = tail_values(df, text, F.col("_clean"))
    df = df.withColumns(
        {
            "invoice_code": fill(F.col("invoice_code"), X.fallback_code(norm)),
            "invoice_no": fill(F.col("invoice_no"), X.fallback_number(norm)),
            "invoice_date": fill(F.col("invoice_date"), X.fallback_date(norm)),
            "total": fill(F.col("total"), X.fallback_total(norm)),
            "_buyer_id": X.buyer_tax_of(F.col("_kept")),
            "_check": X.checksum(norm),
        }
    )
    df = df.withColumn("buyer_tax_id", F.when(F.col("_buyer_id") != "", F.col("_buyer_id")).otherwise(F.col("buyer_tax_id")))
    df = df.withColumn("_seller_id", X.seller_tax_of(F.col("_kept"), F.col("buyer_tax_id")))
    others = F.filter(X.tax_candidates_from_lines(raw), lambda v: (v != F.col("_check")) & (v != F.col("buyer_tax_id")))
    cleared = lambda c: F.when(c == F.col("_check"), "").otherwise(c)
    df = df.withColumn("seller_tax_id", F.when(F.col("_seller_id") != "", F.col("_seller_id")).otherwise(cleared(F.col("seller_tax_id"))))
    df = df.withColumn("seller_tax_id", fill(fill(F.col("seller_tax_id"), F.get(others, F.lit(0))), X.labelled_seller_tax(norm)))
    df = df.withColumn("seller_tax_id", cleared(F.col("seller_tax_id")))
    same = (F.col("buyer_tax_id") != "") & (F.col("buyer_tax_id") == F.col("seller_tax_id"))
    lose_buyer = F.contains("invoice_type", F.lit("普通发票")) | (F.col("_buyer_id") == "")
    df = df.withColumns({"buyer_tax_id": F.when(same & lose_buyer, "").otherwise(F.col("buyer_tax_id")), "seller_tax_id": F.when(same & ~lose_buyer, "").otherwise(F.col("seller_tax_id"))})

    df = df.withColumn("buyer_name", F.when(T.is_company(F.col("buyer_name")), F.col("buyer_name")).otherwise(X.buyer_name_of(F.col("_clean"))))
    df = df.withColumn("buyer_name", fill(F.col("buyer_name"), X.first_company_of(F.col("_clean"))))
    df = df.withColumn("_seller", X.seller_name_of(F.col("_clean"), F.col("buyer_name")))
    df = df.withColumn("seller_name", F.when(F.col("_seller") != "", F.col("_seller")).otherwise(F.col("seller_name")))
    df = df.withColumn("seller_name", F.when(T.is_stamp(F.col("seller_name")) | (F.char_length("seller_name") < 2), F.col("_seller")).otherwise(F.col("seller_name")))
    df = df.withColumn("_firms", F.when(F.col("seller_name") == "", X.companies_of(F.col("_clean"))))
    liked = F.filter("_firms", lambda v: (v != F.col("buyer_name")) & T.contains_any(v, V.PREFERRED_SELLERS))
    second = F.when(F.size("_firms") > 1, F.coalesce(F.get(liked, F.size(liked) - 1), F.get("_firms", F.lit(1))))
    df = df.withColumn("seller_name", fill(F.col("seller_name"), second))

    agent_id = X.agent_tax(norm)
    agent = F.when(F.contains(raw, F.lit("代开企业名称")), X.agent_name_of(F.col("_clean"))).otherwise("")
    df = df.withColumns({"seller_tax_id": F.when(agent_id != "", agent_id).otherwise(F.col("seller_tax_id")), "seller_name": F.when(agent != "", agent).otherwise(F.col("seller_name"))})

    # a split matters only where something is missing or amount and tax may be crossed
    cents = lambda f: F.coalesce(T.cents(F.col(f)), F.lit(0))
    asked = (F.col("amount") == "") | (F.col("tax") == "") | (cents("tax") >= cents("amount"))
    df = df.withColumn("_split", F.when(asked, X.infer_amount_tax(norm, F.col("total"))))
    df = df.withColumns({"amount": fill(F.col("amount"), T.money(F.col("_split")["amount"])), "tax": fill(F.col("tax"), T.money(F.col("_split")["tax"]))})
    crossed = F.col("_split").isNotNull() & (cents("tax") >= cents("amount"))
    df = df.withColumns(
        {
            "amount": F.when(crossed, T.money(F.col("_split")["amount"])).otherwise(F.col("amount")),
            "tax": F.when(crossed, T.money(F.col("_split")["tax"])).otherwise(F.col("tax")),
        }
    )
    lone = (F.col("amount") == "") & (F.col("total") != "") & F.contains("invoice_type", F.lit("普通发票")) & (F.col("tax") == "")
    df = df.withColumn("amount", F.when(lone, F.col("total")).otherwise(F.col("amount")))
    near = X.drawer_near_label_of(F.col("_clean"))
    df = df.withColumn("drawer", F.when(near != "", near).when((F.col("drawer") != "") & ~T.is_person(F.col("drawer")), "").otherwise(F.col("drawer")))
    return df.select(*[c for c in keep], *V.FIELDS)


def completion(fields=V.FIELDS) -> Column:
    """Share of the fields that are filled, to three decimals."""
    n = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return F.round(n / F.lit(len(fields)), 3)
