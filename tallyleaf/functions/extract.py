"""Field extractors over invoice text as column expressions.

``raw`` is the text as read, ``norm`` its normalised form, ``ls`` an array of
lines.  An extractor returns '' when it finds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyleaf.functions import text as T
from tallyleaf.functions import values as V


def first_match(norm: Column, patterns) -> Column:
    """Group 1, never empty, of the first pattern that matches, even if it cleans to ''."""
    if not patterns:
        return F.lit("")

    def found(p: str, *others: str) -> Column:
        one = F.regexp_extract(norm, java(p), 1)
        return T.let(one, lambda v: F.when(v != "", v).otherwise(found(*others))) if others else one

    return T.let(F.coalesce(F.substring_index(found(*patterns), "\n", 1), F.lit("")), T.clean)


def java(pattern: str) -> str:
    """A primary pattern for Java.

    Letters are the same in both cases and a dot may be a line end, which is said
    only where it matters: without it a search starts by a plain one for the label.
    """
    bare = re.sub(r"\\.", "", pattern)
    flags = ("i" if re.search("[A-Za-z]", bare) else "") + ("s" if "." in bare else "")
    return (f"(?{flags})" if flags else "") + pattern.replace("\\d", "[0-9]").replace("\\s", "(?U:\\s)")


def number_candidates(norm: Column) -> Column:
    return T.find_all(norm, "(?i)(?<![A-Z0-9])[0-9]{6,20}(?![A-Z0-9])")


def tax_candidates(norm: Column) -> Column:
    return F.array_distinct(F.concat(T.find_all(norm, "纳税人识别号[:：]?\\s*([0-9A-Z]{12,20})", 1), T.find_all(norm, V.ID_FIND)))


def window(ls: Column, k: Column, n: int) -> Column:
    return F.array_join(F.slice(ls, k + 1, F.lit(n)), "")


def tax_candidates_from_lines(raw: Column) -> Column:
    none = F.array().cast("array<string>")

    def near(ls: Column) -> Column:
        found = lambda x, k: F.when(T.contains_any(x, ("纳税人识别号", "税号")), T.find_all(window(ls, k, 3), "[0-9A-Z]{12,20}")).otherwise(none)
        return F.flatten(F.transform(ls, found))

    return F.array_distinct(F.concat(T.let(F.transform(F.split(raw, T.LINE_END), T.normalize), near), T.let(T.normalize(raw), tax_candidates)))


def tax_in(block: Column) -> Column:
    """First acceptable tax number of a block of lines: near a label, else bounded and alone."""
    return T.let(block, _tax_in)


def _tax_in(scope: Column) -> Column:
    good = lambda found: T.first(F.filter(found, T.is_tax_number))
    near = first_of(scope, lambda x, k: F.when(T.contains_any(x, V.TAX_LABELS), good(T.find_all(window(scope, k, 4), "[0-9A-Z]{12,20}"))))
    alone = first_of(scope, lambda x, k: F.when(~T.contains_any(x, V.TAX_NOISE), good(T.find_all(x, "(?<![0-9A-Z])[0-9A-Z]{15,20}(?![0-9A-Z])"))))
    return T.let(near, lambda v: F.when(v != "", v).otherwise(alone))


def first_of(ls: Column, make) -> Column:
    """The first of ``make(line, number)`` that isn't '' or null, which isn't made for later lines; '' if there is none."""
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("v"))
    step = lambda acc, x: F.when(acc["v"] != "", acc).otherwise(F.struct((acc["k"] + 1).alias("k"), F.coalesce(make(x, acc["k"]), F.lit("")).alias("v")))
    return F.coalesce(F.aggregate(ls, start, step, lambda acc: acc["v"]), F.lit(""))


def kept_lines(raw: Column) -> Column:
    """Normalised lines without those that clean to nothing."""
    return T.let(T.clean_lines(raw), lambda cleaned: kept_of(raw, T.normalize(raw), cleaned))


def kept_of(raw: Column, norm: Column, cleaned: Column) -> Column:
    """As ``kept_lines``, of a text, its normalised form and all of its lines cleaned."""
    # lines of the normalised text are the normalised lines unless blanks between the parts of a line end have gone
    own = F.when(F.contains(raw, F.lit("\r")), F.transform(F.split(raw, T.LINE_END), T.normalize)).otherwise(T.lines(norm))
    return F.filter(own, lambda x, k: F.get(cleaned, k) != "")


def buyer_tax(raw: Column) -> Column:
    return T.let(kept_lines(raw), buyer_tax_of)


def buyer_tax_of(ls: Column) -> Column:
    def block(x: Column, k: Column) -> Column:
        ahead = F.slice(ls, k + 2, F.lit(29))
        stop = F.array_min(F.filter(F.transform(ahead, lambda y, i: F.when(T.contains_any(y, V.BUYER_STOPS), i + 1)), lambda i: i.isNotNull()))
        return F.when(F.contains(x, F.lit("买方")), tax_in(F.slice(ls, k + 1, F.coalesce(stop, F.lit(16)))))

    return first_of(ls, block)


def seller_tax(raw: Column, buyer: Column) -> Column:
    return T.let(kept_lines(raw), lambda ls: seller_tax_of(ls, buyer))


def seller_tax_of(ls: Column, buyer: Column) -> Column:
    start = F.coalesce(F.array_min(F.transform(ls, lambda x, k: F.when(T.contains_any(x, V.TOTAL_MARKS), k))), F.lit(0))
    below = F.slice(ls, start + 1, F.greatest(F.size(ls), F.lit(1)))
    return first_of(below, lambda x, k: F.when(~T.contains_any(x, V.TAX_NOISE), T.first(F.filter(T.find_all(x, V.ID_FIND), lambda v: v != buyer))))


def checksum(norm: Column) -> Column:
    return F.regexp_extract(norm, "校验码[:：]?(?U:\\s)*([0-9]{12,30})", 1)


def agent_tax(norm: Column) -> Column:
    return F.when(~F.contains(norm, F.lit("代开企业税号")), "").otherwise(F.regexp_extract(norm, "代开企业税号[:：]?\\s*((?i:[0-9A-Z]{12,20}))", 1))


def labelled_seller_tax(norm: Column) -> Column:
    return F.when(agent_tax(norm) != "", agent_tax(norm)).otherwise(F.regexp_extract(norm, "(?is)销售方.{0,100}?(?:纳税人识别号|税号)[:：]?\\s*([0-9A-Z]{12,20})", 1))


def agent_name(raw: Column) -> Column:
    """Name after 代开企业名称, pieced together over up to seven later lines."""
    # texts without the label, nearly all, are done at once
    return F.when(F.contains(raw, F.lit("代开企业名称")), T.let(T.nonempty(raw), agent_name_of)).otherwise("")


def agent_name_of(ls: Column) -> Column:
    keep = f"[^{V.CJK}A-Za-z0-9（）()]"
    start_state = lambda piece: F.struct(piece.alias("name"), F.char_length(piece).alias("size"), F.lit(False).alias("done"))

    def at(x: Column, k: Column) -> Column:
        inline = F.regexp_replace(x, "^.*?代开企业名称[:：]?", "")
        lead = T.let(T.let(inline, T.clean), lambda v: F.when((v != "") & ~T.contains_any(v, V.AGENT_SKIPS + V.AGENT_STOPS), F.regexp_replace(v, keep, "")).otherwise(""))
        later = F.transform(F.slice(ls, k + 2, F.lit(7)), lambda y: F.regexp_replace(y, keep, ""))

        def fold(acc: Column, y: Column) -> Column:
            stop = acc["done"] | T.contains_any(y, V.AGENT_STOPS)
            skip = (y == "") | y.isin(*V.AGENT_SKIPS)
            grown = F.struct(F.concat(acc["name"], y).alias("name"), (acc["size"] + F.char_length(y)).alias("size"), (acc["size"] + F.char_length(y) >= 2).alias("done"))
            ended = F.struct(acc["name"].alias("name"), acc["size"].alias("size"), F.lit(True).alias("done"))
            piece = y.rlike(f"\\A[{V.CJK}]{{1,6}}\\z")
            return F.when(acc["done"], acc).when(y == "", acc).when(stop, ended).when(skip, acc).when(T.is_company(y), ended).when(piece, grown).otherwise(acc)

        name = F.trim(F.aggregate(later, start_state(lead), fold, lambda acc: acc["name"]))
        return F.when(F.contains(x, F.lit("代开企业名称")), T.let(name, lambda v: F.when(F.char_length(v).between(2, 20), v)))

    return first_of(ls, at)


COMPANY = f"([{V.CJK}A-Za-z0-9（）()]{{2,}}(?:{V.ORG_SUFFIX}))"
NAMED_COMPANY = "(?:名称|名(?U:\\s)*称|称)[:：]?(?U:\\s)*" + COMPANY


def company(c: Column) -> Column:
    """A company name in a line: the labelled one, else any."""

    def checked(found: Column, other: Column) -> Column:
        return T.let(T.let(found, T.clean), lambda v: F.when(T.is_company(v), v).otherwise(other))

    any_ = checked(F.regexp_extract(c, COMPANY, 1), F.lit(""))
    named = lambda v: F.when(v == "", any_).otherwise(checked(v, any_))
    # most lines hold no organisation suffix at all, and most that do no label
    return F.when(T.has_suffix(c), F.when(F.contains(c, F.lit("称")), T.let(F.regexp_extract(c, NAMED_COMPANY, 1), named)).otherwise(any_)).otherwise("")


def companies(raw: Column) -> Column:
    return T.let(T.nonempty(raw), companies_of)


def companies_of(ls: Column) -> Column:
    """The companies in cleaned lines, except in those of a stamp."""
    firms = F.transform(ls, lambda x: F.when(~T.is_stamp(x), company(x)).otherwise(""))
    return F.array_distinct(nonblank(firms))


def first_company_of(ls: Column) -> Column:
    """The first of ``companies_of``; '' if there is none."""
    return first_of(ls, lambda x, k: F.when(~T.is_stamp(x), company(x)))


def nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda v: v != "")


def buyer_name(raw: Column) -> Column:
    return T.let(T.nonempty(raw), buyer_name_of)


def buyer_name_of(ls: Column) -> Column:
    """The company in the block of lines around 购买方; companies of single lines are looked for only if the block as a whole has none."""

    def at(x: Column, k: Column) -> Column:
        lo = F.greatest(F.lit(0), k - 6)
        scope = F.slice(ls, lo + 1, k + 12 - lo)
        stop = F.array_min(F.transform(scope, lambda y, i: F.when(T.contains_any(y, ("销售方", "货物或应税劳务", "价税合计")), i)))
        win = F.slice(ls, lo + 1, F.coalesce(stop, F.size(scope)))
        whole = lambda w: T.let(F.array_join(w, ""), company)
        return F.when(F.contains(x, F.lit("购买方")), T.let(win, lambda w: T.let(whole(w), lambda v: F.when(v != "", v).otherwise(first_of(w, lambda y, i: company(y))))))

    return first_of(ls, at)


def seller_name(raw: Column, buyer: Column) -> Column:
    return T.let(T.nonempty(raw), lambda ls: seller_name_of(ls, buyer))


def seller_name_of(ls: Column, buyer: Column) -> Column:
    """The company after a mark of the total, within 35 lines, else one around 销售方; no line is searched once it is found."""
    # marks come one after the other, so the first company within reach of any is that of the first mark that has one
    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("v"))

    def below(acc: Column, x: Column) -> Column:
        left = F.when(T.contains_any(x, V.TOTAL_MARKS), 35).otherwise(acc["left"])
        good = T.let(company(x), lambda v: F.when((v != buyer) & ~T.contains_any(v, V.BANK_NOISE), v).otherwise(""))
        then = T.let(left, lambda n: F.struct(F.greatest(n - 1, F.lit(0)).alias("left"), F.when(n > 0, good).otherwise("").alias("v")))
        return F.when(acc["v"] != "", acc).otherwise(then)

    def near_label(x: Column, k: Column) -> Column:
        lo = F.greatest(F.lit(0), k - 5)
        block = F.slice(ls, lo + 1, k + 8 - lo)
        named = lambda w: T.let(T.let(F.regexp_extract(F.array_join(w, ""), NAMED_COMPANY, 1), T.clean), lambda v: F.when(T.is_company(v) & (v != buyer), v).otherwise(""))
        other = lambda w: first_of(w, lambda y, i: T.let(company(y), lambda v: F.when(v != buyer, v)))
        return F.when(F.contains(x, F.lit("销售方")), T.let(block, lambda w: T.let(named(w), lambda v: F.when(v != "", v).otherwise(other(w)))))

    by_total = F.coalesce(F.aggregate(ls, start, below, lambda acc: acc["v"]), F.lit(""))
    return T.let(by_total, lambda v: F.when(v != "", v).otherwise(first_of(ls, near_label)))


def fallback_code(norm: Column) -> Column:
    return T.let(number_candidates(norm), _code_of)


def _code_of(numbers: Column) -> Column:
    c = F.filter(numbers, lambda v: F.char_length(v).between(10, 12) & ~v.startswith("20"))
    stem = lambda v: F.substring(v, F.lit(1), F.char_length(v) - 1)
    twins = F.flatten(F.transform(c, lambda v, k: F.filter(F.slice(c, k + 2, F.size(c)), lambda w: (F.char_length(w) == F.char_length(v)) & (stem(w) == stem(v)))))
    return F.when(F.size(twins) > 0, F.get(twins, F.lit(0))).otherwise(T.first(c))


def fallback_number(norm: Column) -> Column:
    label = "(?i)(?:发票号码|号码|No)[:：]?(?U:\\s)*([0-9]{8,20})(?![0-9])"
    c = F.filter(number_candidates(norm), lambda v: ~v.startswith("20"))
    eight = F.filter(c, lambda v: F.char_length(v) == 8)
    more = F.filter(c, lambda v: F.char_length(v) >= 9)
    return F.when(norm.rlike(label), F.regexp_extract(norm, label, 1)).otherwise(T.first(F.concat(eight, more)))


def fallback_date(norm: Column) -> Column:
    near = "开票日期[:：]?(?U:\\s)*(20[0-9]{2})[^0-9]{0,8}([01]?[0-9])[^0-9]{0,8}([0-3]?[0-9])"
    apart = "(20[0-9]{2})[年\\-/\\.]([01]?[0-9])[月\\-/\\.]([0-3]?[0-9])日?"
    solid = "(?<![0-9])(20[0-9]{6})(?![0-9])"

    def made(p: str) -> Column:
        y, m, d = (F.regexp_extract(norm, p, k) for k in (1, 2, 3))
        ok = F.expr("true") & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
        return F.when(norm.rlike(p) & ok, F.concat(y, F.lit("年"), F.lpad(m, 2, "0"), F.lit("月"), F.lpad(d, 2, "0"), F.lit("日"))).otherwise("")

    s = F.regexp_extract(norm, solid, 1)
    whole = F.concat(F.substring(s, 1, 4), F.lit("年"), F.substring(s, 5, 2), F.lit("月"), F.substring(s, 7, 2), F.lit("日"))
    return F.when(norm.rlike(near), safe(norm, near, made)).when(norm.rlike(apart), safe(norm, apart, made)).when(s != "", whole).otherwise("")


def safe(norm: Column, p: str, made) -> Column:
    """Casts only where the pattern matched (ANSI casts of '' fail)."""
    return F.when(norm.rlike(p), made(p)).otherwise("")


def money_candidates(norm: Column) -> Column:
    found = F.transform(T.find_all(norm, V.MONEY_FIND, 1), lambda v: F.replace(v, F.lit(","), F.lit("")))
    # all have two decimals
    fits = lambda v: T.let(F.when(F.char_length(v) <= 18, T.whole_cents(v)), lambda c: (c > 0) & (c <= 100_000_000_000))
    return F.array_distinct(F.filter(found, fits))


def fallback_total(norm: Column) -> Column:
    c = F.transform(money_candidates(norm), lambda v, k: F.struct(T.whole_cents(v).alias("c"), (-k).alias("k"), v.alias("v")))
    return F.coalesce(F.array_max(c)["v"], F.lit(""))


def infer_amount_tax(norm: Column, total: Column) -> Column:
    """Struct (amount, tax) in cents: the first pair that adds up, else by the first rate in percent."""
    t = T.cents(total)
    return T.let(F.transform(money_candidates(norm), T.whole_cents), lambda all_cents: _split_of(norm, t, all_cents))


def _split_of(norm: Column, t: Column, all_cents: Column) -> Column:
    vals = F.filter(all_cents, lambda v: v != t)
    pairs = F.flatten(F.transform(vals, lambda a, k: F.transform(F.filter(F.slice(vals, k + 2, F.greatest(F.size(vals), F.lit(1))), lambda b: F.abs(a + b - t) <= 1), lambda b: F.struct(F.greatest(a, b).alias("amount"), F.least(a, b).alias("tax")))))
    rates = F.filter(F.transform(T.find_all(norm, "([0-9]{1,2})%", 1), lambda r: r.cast("int")), lambda r: r.between(1, 17))
    rate = F.get(rates, F.lit(0))
    split = F.floor((t * 200 + 100 + rate) / (2 * (100 + rate))).cast("bigint")
    return F.when(F.size(pairs) > 0, F.get(pairs, F.lit(0))).when(rate.isNotNull() & t.isNotNull(), F.struct(split.alias("amount"), (t - split).alias("tax")))


def drawer_near_label(raw: Column) -> Column:
    return T.let(T.nonempty(raw), drawer_near_label_of)


def drawer_near_label_of(ls: Column) -> Column:
    def named(win: Column) -> Column:
        inline = F.regexp_extract(T.normalize(F.get(win, F.lit(0))), f"开票人[:：]?(?U:\\s)*([{V.CJK}]{{2,4}})", 1)
        short = F.filter(F.transform(F.slice(win, F.lit(2), F.lit(4)), T.cjk_only), lambda x: (F.char_length(x) <= 4) & T.is_person(x))
        return T.let(inline, lambda v: F.when((v != "") & T.is_person(v), v).otherwise(T.first(short)))

    last = F.array_max(F.filter(F.transform(ls, lambda x, k: F.when(F.contains(x, F.lit("开票人")), k)), lambda k: k.isNotNull()))
    return F.when(last.isNull(), "").otherwise(T.let(F.slice(ls, F.coalesce(last, F.lit(0)) + 1, F.lit(5)), named))


def is_day(c: Column) -> Column:
    return c.rlike("\\A20[0-9]{6}\\z") | c.rlike("\\A20[0-9]{2}年[01]?[0-9]月[0-3]?[0-9]日\\z")


def drawer_in_tail(tail: Column) -> Column:
    """State machine over the values after the last 开票人 label."""
    flag = "[壹贰叁肆伍陆柒捌玖拾佰仟万亿圆元角分整]|价税合计"

    def fold(acc: Column, x: Column) -> Column:
        to = lambda on, over, name: F.struct(on.alias("on"), over.alias("over"), name.alias("name"))
        opened = x.rlike(flag) | (~acc["on"] & x.rlike("\\A[¥￥]?[0-9]+(?:\\.[0-9]{2})\\z"))
        return (
            F.when(acc["over"], acc)
            .when(opened, to(F.lit(True), acc["over"], acc["name"]))
            .when(~acc["on"], acc)
            .when(is_day(x) | T.is_company(x), to(acc["on"], F.lit(True), acc["name"]))
            .when(T.is_person(x), to(acc["on"], F.lit(True), x))
            .otherwise(acc)
        )

    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.lit("").alias("name"))
    return F.aggregate(F.transform(tail, T.normalize), start, fold, lambda acc: acc["name"])


def invoice_type(current: Column, norm: Column) -> Column:
    has = lambda w: F.contains(norm, F.lit(w))
    return (
        F.when(has("电子") & has("普通发票"), F.when(has("增值税"), "增值税电子普通发票").otherwise("电子发票"))
        .when(has("专用发票"), "增值税专用发票")
        .when(norm.rlike("增[^\n]{0,2}税普通发票"), "增值税普通发票")
        .otherwise(current)
    )
