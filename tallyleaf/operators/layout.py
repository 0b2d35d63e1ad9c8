"""Lines with boxes: reading order, regions, spatial joins, choices by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.functions import values as V
from tallyleaf.operators import pages

#: A lines table has doc_id, line_no, text, score, x1, y1, x2, y2.


def with_geometry(lines: DataFrame) -> DataFrame:
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    return lines.withColumns({"cx": centre("x1", "x2"), "cy": centre("y1", "y2"), "height": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))})


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines that are not blank with ``place``, by (y1, x1) and then line_no."""
    w = Window.partitionBy("doc_id").orderBy("y1", "x1", "line_no")
    return lines.where(T.clean(F.col("text")) != "").withColumn("place", F.row_number().over(w) - 1)


def joined_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of a document in reading order."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return reading_order(lines).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


#: What a page's lines hold: place, number, text and score.
LINE = ("y1", "x1", "line_no", "text", "score", "x2", "y2")


def line_facts(x: Column) -> Column:
    text = F.coalesce(x["text"], F.lit(""))
    return F.struct(
        *[x[c].alias(c) for c in ("y1", "x1", "line_no")],
        text.alias("text"),
        x["score"].alias("score"),
        ((x["x1"] + x["x2"]) / 2).alias("cx"),
        ((x["y1"] + x["y2"]) / 2).alias("cy"),
        F.greatest(F.lit(1.0), x["y2"] - x["y1"]).alias("height"),
        T.squeeze(text).alias("t"),
        T.clean(text).alias("c"),
    )


def with_items(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds ``_l``: the lines of a page that are not blank, in reading order, with what the rules ask of them."""
    made = F.filter(F.transform(lines, line_facts), lambda x: x["c"] != "")
    return df.withColumn("_l", F.coalesce(F.array_sort(made), F.array()))


def line_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, lines): pages of lines."""
    return pages.collected(lines, LINE, "lines")


def region_bounds(items: Column, height: float) -> Column:
    """(buyer_start, buyer_end, seller_start) from the first anchor lines of a page."""
    first = lambda words: F.get(pages.where(items, lambda x: T.contains_any(x["t"], words)), F.lit(0))["y1"]
    start = F.coalesce(first(("购买方", "买方")), F.lit(0.18 * height))
    stop = first(V.BUYER_STOPS)
    return F.struct(
        F.greatest(F.lit(0.0), start - 0.02 * height).alias("buyer_start"),
        F.least(F.lit(float(height)), F.when(stop > start, stop).otherwise(0.5 * height)).alias("buyer_end"),
        F.least(F.lit(0.58 * height), first(V.TOTAL_MARKS), first(("销售方", "销售信息"))).alias("seller_start"),
    )


def regions(lines: DataFrame, height: float) -> DataFrame:
    """(doc_id, buyer_start, buyer_end, seller_start) of pages with text."""
    return page_regions(line_pages(lines), height)


def page_regions(pages: DataFrame, height: float) -> DataFrame:
    """As ``regions``, of pages (doc_id, lines) whose lines come as arrays."""
    found = with_items(pages)
    # rows come from an array, as a filter on what was found would be pushed down with all of its making
    r = F.when(F.size("_l") > 0, F.array(region_bounds(F.col("_l"), height)))
    return found.select("doc_id", F.inline_outer(r)).where("buyer_start is not null")


def pairs_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = with_geometry(lines)
    cols = ("doc_id", "line_no", "text", "cx", "cy")
    label = g.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    return label, g.select(*[F.col(c).alias(f"v_{c}") for c in cols])


def best_pair(df: DataFrame, distance: Column) -> DataFrame:
    """Per document the value at the least distance; the first label and the first value win ties."""
    w = Window.partitionBy("v_doc_id").orderBy("distance", "l_line_no", "v_line_no")
    best = df.withColumn("distance", distance).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(F.col("v_doc_id").alias("doc_id"), F.col("v_line_no").alias("line_no"), F.col("v_text").alias("text"), "distance")


def nearest_value(lines: DataFrame, label: Column, value: Column, y_window: float = 80.0, below: bool = True) -> DataFrame:
    """The value nearest to a label on its row or, failing that, under it.

    ``label`` and ``value`` are predicates over l_text and v_text.
    """
    a, b = pairs_of(lines)
    dy, dx = F.col("v_cy") - F.col("l_cy"), F.col("v_cx") - F.col("l_cx")
    row = (F.abs(dy) <= y_window) & (dx >= -40)
    under = F.lit(below) & (dy > 0) & (dy <= 2 * y_window) & (F.abs(dx) <= 320)
    met = a.where(label).join(b.where(value), (F.col("l_doc_id") == F.col("v_doc_id")) & (F.col("l_line_no") != F.col("v_line_no")) & (row | under))
    return best_pair(met, F.abs(dy) + F.greatest(F.lit(0.0), dx) + F.when(row, 0).otherwise(120))


def column_value(lines: DataFrame, label: Column, value: Column, height: float) -> DataFrame:
    """The value under a label in its column."""
    a, b = pairs_of(lines)
    dy, dx = F.col("v_cy") - F.col("l_cy"), F.abs(F.col("v_cx") - F.col("l_cx"))
    near = (dy > 0) & (dy <= 0.42 * height) & (dx <= 150)
    return best_pair(a.where(label).join(b.where(value), (F.col("l_doc_id") == F.col("v_doc_id")) & near), 2 * dx + F.abs(dy))


def triple_score(t, a, x, height: float, width: float) -> Column:
    """How well total, amount and tax (anything that gives columns by name) sit on the page."""
    row = F.abs(a["cy"] - x["cy"]) <= 2.2 * F.greatest(a["height"], x["height"])
    left = (a["cx"] <= x["cx"]) | (F.abs(a["cx"] - x["cx"]) < 0.05 * width)
    return (
        100.0
        + F.when(row, 40).otherwise(-40)
        + F.when(left, 35).otherwise(-35)
        + F.when(t["named"], 25).otherwise(0)
        + F.least(F.lit(30.0), (t["cy"] - a["cy"]) / height * 120)
        + F.least(F.lit(300.0), t["score"] + a["score"] + x["score"]) * 0.05
    )


def amount_tax_total(lines: DataFrame, height: float, width: float) -> DataFrame:
    """(doc_id, amount, tax, total) in cents: the triple that adds up and sits best, else the last sum of the page alone."""
    return page_sums(line_pages(lines), height, width)


def page_sums(pages: DataFrame, height: float, width: float) -> DataFrame:
    """As ``amount_tax_total``, of pages (doc_id, lines) whose lines come as arrays."""
    low = F.filter("lines", lambda x: x["y1"] + x["y2"] >= 0.7 * height)
    sums = sums_of(F.transform(low, line_facts_of_sums), height, width)
    found = pages.select("doc_id", F.inline_outer(F.array(sums)))
    return found.where("total is not null")


def windows(items: Column, ahead: int, make) -> Column:
    """``make`` of each line and of the squeezed text of it and the lines after it."""
    text = lambda own, k: F.array_join(F.transform(F.slice(own, k + 1, F.lit(ahead + 1)), lambda x: x["t"]), "")
    # bound by let, or the array would be made anew for each line
    return T.let(items, lambda own: F.transform(own, lambda x, k: make(x, text(own, k))))


def inside(items: Column, start: Column, end: Column) -> Column:
    """Lines whose centre lies between two heights."""
    return T.let(F.struct(start.alias("start"), end.alias("end")), lambda r: pages.where(items, lambda x: x["cy"].between(r["start"], r["end"])))


def tax_id_of(items: Column, exclude: Column | None = None) -> Column:
    """The best tax id of the lines and of the three after each."""
    good = lambda w: T.first(F.filter(T.find_all(w, "(?i)(?<![0-9A-Z])[0-9A-Z]{12,20}(?![0-9A-Z])"), T.is_tax_number))
    score = lambda x: x["score"] + F.when(T.contains_any(x["t"], V.TAX_LABELS), 40).otherwise(0) - F.when(T.contains_any(x["t"], ("开户行", "账号", "规格型号")), 60).otherwise(0)
    found = windows(items, 3, lambda x, w: F.struct(score(x).alias("s"), (-x["cy"]).alias("y"), good(w).alias("value")))
    found = F.filter(found, lambda v: (v["value"] != "") if exclude is None else (v["value"] != "") & (v["value"] != exclude))
    return F.array_max(found)["value"]


def company_of(items: Column, reject_banks: bool = False) -> Column:
    """The best company name of the lines."""
    firms = pages.where(items, lambda x: ~T.contains_any(x["c"], V.REGION_NAME_NOISE) & T.is_company(x["c"]))

    def scored(x: Column) -> Column:
        c = x["c"]
        score = x["score"] + F.when(F.contains(c, F.lit("称")), 20).otherwise(0) + F.when(F.contains(c, F.lit("公司")), 15).otherwise(0)
        if reject_banks:
            score = score - F.when(T.contains_any(c, ("银行", "支行", "分行", "开户行", "账号")), 60).otherwise(0)
        return F.struct(score.alias("s"), T.clean(F.regexp_replace(c, "^(名称|名(?U:\\s)*称|称)[:：]?", "")).alias("value"))

    return F.array_max(F.transform(firms, scored))["value"]


def checksum_of(items: Column, height: float) -> Column:
    """The best digit run of the label's line and the three after it; of one line's runs the greatest."""
    runs = lambda w: F.filter(T.find_all(w, "[0-9][0-9]{10,35}[0-9]"), lambda v: F.char_length(v).between(12, 30))
    of = lambda x, w: F.when(F.contains(x["t"], F.lit("校验码")), F.transform(runs(w), lambda v: F.struct((x["score"] + 20 * (1 - x["cy"] / height)).alias("s"), v.alias("value"))))
    return F.array_max(F.flatten(F.filter(windows(items, 3, of), lambda a: a.isNotNull())))["value"]


def drawer_of(items: Column, height: float) -> Column:
    """The name on the drawer's label line, in the four lines after it, or alone at the foot."""
    inline = lambda x: F.regexp_extract(x["t"], f"开票人[:：]?([{V.CJK}]{{2,4}})", 1)
    scored = lambda s, names: F.transform(names, lambda v: F.struct(s.alias("s"), v.alias("value")))
    people = lambda c, pattern: F.filter(T.find_all(c, pattern), T.is_person)

    def after(own: Column, x: Column, k: Column) -> Column:
        later = F.slice(own, k + 2, F.lit(4))
        return F.flatten(F.transform(later, lambda y, d: scored(x["score"] + 65 - 5 * d, people(y["t"], f"[{V.CJK}]{{2,4}}"))))

    def of(own: Column, x: Column, k: Column) -> Column:
        name = inline(x)
        good = (name != "") & T.is_person(name)
        foot = F.when(x["cy"] > 0.82 * height, scored(x["score"].cast("double"), people(x["t"], f"(?<![{V.CJK}])[{V.CJK}]{{2,4}}(?![{V.CJK}])")))
        label = F.when(F.contains(x["t"], F.lit("开票人")), after(own, x, k))
        none = F.array().cast("array<struct<s:double,value:string>>")
        return F.when(good, scored((x["score"] + 80).cast("double"), F.array(name))).otherwise(F.concat(F.coalesce(label, none), F.coalesce(foot, none)))

    return F.array_max(T.let(items, lambda own: F.flatten(F.transform(own, lambda x, k: of(own, x, k)))))["value"]


def amounts_of(items: Column, height: float, width: float) -> Column:
    """(amount, tax, total) in cents, by the rules of ``amount_tax_total``; null without any sum on the page.

    Totals and amounts are paired first, as far as the amount can be the
    larger part of the total, and taxes are looked for under such pairs only.
    """
    return sums_of(pages.where(items, lambda x: x["cy"] >= 0.35 * height), height, width)


def line_facts_of_sums(x: Column) -> Column:
    """What sums ask of a line, be it blank or not."""
    text = F.coalesce(x["text"], F.lit(""))
    centre = lambda a, b: (x[a] + x[b]) / 2
    return F.struct(x["line_no"].alias("line_no"), text.alias("text"), x["score"].alias("score"), centre("x1", "x2").alias("cx"), centre("y1", "y2").alias("cy"), F.greatest(F.lit(1.0), x["y2"] - x["y1"]).alias("height"), T.squeeze(text).alias("t"))


def sums_of(lower: Column, height: float, width: float) -> Column:
    """As ``amounts_of``, of the lines in the lower part of the page."""
    low = pages.where(lower, lambda x: ~T.contains_any(x["t"], V.NO_MONEY))
    sums = lambda x: F.filter(F.transform(T.find_all(x["text"], V.MONEY_FIND, 1), lambda v: T.cents(F.replace(v, F.lit(","), F.lit("")))), lambda c: (c > 0) & (c < 100_000_000_000))
    named = lambda x: T.contains_any(x["t"], V.TOTAL_MARKS)
    cands = F.flatten(F.transform(low, lambda x: F.transform(sums(x), lambda c, n: F.struct(x["line_no"].alias("line_no"), n.alias("cand_no"), c.alias("cents"), *[x[f].alias(f) for f in ("cx", "cy", "height", "score")], named(x).alias("named")))))

    def best(money: Column) -> Column:
        fits = lambda t, a: (a["cy"] < t["cy"]) & (a["cents"] <= t["cents"] + 3) & (2 * a["cents"] >= t["cents"] - 3)
        sums_to = lambda p, x: (F.abs(p["t"]["cents"] - p["a"]["cents"] - x["cents"]) <= 3) & (x["cy"] < p["t"]["cy"]) & (p["a"]["cents"] >= x["cents"]) & ((x["line_no"] != p["a"]["line_no"]) | (x["cand_no"] != p["a"]["cand_no"]))
        two = pages.pairs(pages.where(money, lambda t: t["cy"] >= 0.55 * height), money, fits, lambda t, a: F.struct(t.alias("t"), a.alias("a")))
        at = lambda x: [x["line_no"], x["cand_no"]]
        score = lambda p, x: triple_score(p["t"], p["a"], x, height, width)
        three = pages.pairs(two, money, sums_to, lambda p, x: F.struct((-score(p, x)).alias("s"), F.struct(*at(p["t"]), *at(p["a"]), *at(x)).alias("at"), p["a"]["cents"].alias("amount"), x["cents"].alias("tax"), p["t"]["cents"].alias("total")))
        last = F.array_max(F.transform(money, lambda x: F.struct(x["named"], x["cy"], x["cents"].alias("cents"))))["cents"]
        return T.let(F.array_min(three), lambda b: F.when(F.size(money) > 0, F.struct(b["amount"].alias("amount"), b["tax"].alias("tax"), F.coalesce(b["total"], last).alias("total"))))

    return T.let(cands, best)


def valued(df: DataFrame, value: Column) -> DataFrame:
    """(doc_id, value) where there is one; as rows of an array, or the filter would be pushed down with all of its making."""
    return df.select("doc_id", F.explode_outer(F.array(value)).alias("value")).where("value is not null")


def choose_tax_id(lines: DataFrame, scope: DataFrame) -> DataFrame:
    """(doc_id, value): the best tax id among lines whose centre lies in scope (doc_id, start, end)."""
    found = with_items(line_pages(lines)).join(scope, "doc_id")
    return valued(found, tax_id_of(inside(F.col("_l"), F.col("start"), F.col("end"))))


def page_tax_ids(pages: DataFrame, height: float) -> DataFrame:
    """(doc_id, role, value): the best tax ids of the buyer's and of the seller's region of pages (doc_id, lines)."""
    found = with_items(pages).withColumn("_r", region_bounds(F.col("_l"), height))
    scopes = {"buyer": ("buyer_start", F.col("_r")["buyer_end"]), "seller": ("seller_start", F.lit(float(height)))}
    best = [F.struct(F.lit(role).alias("role"), tax_id_of(inside(F.col("_l"), F.col("_r")[start], end)).alias("value")) for role, (start, end) in scopes.items()]
    return found.select("doc_id", F.inline(F.array(*best))).where("value is not null")


def choose_checksum(lines: DataFrame, height: float) -> DataFrame:
    return page_checksum(line_pages(lines), height)


def page_checksum(pages: DataFrame, height: float) -> DataFrame:
    """(doc_id, value) of pages (doc_id, lines) whose lines come as arrays."""
    return valued(with_items(pages), checksum_of(F.col("_l"), height))


def refine_pages(df: DataFrame, height: float, width: float) -> DataFrame:
    """Records with a page's ``lines`` corrected by what lies where on it; what is not found stays.

    No row moves: all choices are made from the array of lines.  A page without lines, or with null for them, keeps its record.
    """
    keep = df.columns
    out = with_items(df)
    out = out.withColumn("_r", region_bounds(F.col("_l"), height))
    r = F.col("_r")
    out = out.withColumns({"_upper": inside(F.col("_l"), r["buyer_start"], r["buyer_end"]), "_lower": inside(F.col("_l"), r["seller_start"], F.lit(float(height)))})
    out = out.withColumn("_b_id", tax_id_of(F.col("_upper")))
    out = out.withColumns(
        {
            "_s_id": tax_id_of(F.col("_lower"), F.coalesce("_b_id", "buyer_tax_id", F.lit(""))),
            "_b": company_of(F.col("_upper")),
            "_s": company_of(F.col("_lower"), True),
            "_check": checksum_of(F.col("_l"), height),
            "_drawer": drawer_of(F.col("_l"), height),
            "_sums": amounts_of(F.col("_l"), height, width),
        }
    )
    sums = F.col("_sums")
    out = out.withColumns(
        {
            "buyer_tax_id": F.coalesce("_b_id", "buyer_tax_id"),
            "seller_tax_id": F.coalesce("_s_id", "seller_tax_id"),
            "buyer_name": F.coalesce("_b", "buyer_name"),
            "seller_name": F.coalesce(F.when(F.col("_b").isNull() | ~F.contains("_s", F.col("_b")), F.col("_s")), "seller_name"),
            "checksum": F.coalesce("_check", "checksum"),
            "drawer": F.coalesce("_drawer", "drawer"),
            "amount": F.coalesce(F.when(sums["tax"].isNotNull(), T.money(sums["amount"])), "amount"),
            "tax": F.coalesce(T.money(sums["tax"]), "tax"),
            "total": F.coalesce(T.money(sums["total"]), "total"),
        }
    )
    plain = F.contains("invoice_type", F.lit("普通发票"))
    is_check = lambda c: F.coalesce(F.col(c) == F.col("_check"), F.lit(False))
    some = F.size("_l") > 0
    out = out.withColumn("buyer_tax_id", F.when(some & ((F.col("buyer_tax_id") == F.col("seller_tax_id")) & plain | is_check("buyer_tax_id")), "").otherwise(F.col("buyer_tax_id")))
    out = out.withColumn("seller_tax_id", F.when(is_check("seller_tax_id"), "").otherwise(F.col("seller_tax_id")))
    out = out.withColumn("buyer_name", F.when(some & (F.col("buyer_name") == F.col("seller_name")), "").otherwise(F.col("buyer_name")))
    return out.select(*keep)


def refine(records: DataFrame, lines: DataFrame, height: float, width: float) -> DataFrame:
    """Records of pages whose lines are rows of their own, which are collected once."""
    return refine_pages(records.join(line_pages(lines), "doc_id", "left"), height, width).select(*records.columns)
