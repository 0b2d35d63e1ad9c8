"""Text scalars and predicates as column expressions (no Python at run time)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyleaf.functions import values as V

BLANK = "(?U)[\\s\\x1c-\\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Blanks besides a space and a plain line end, and all blanks one by one.
ODD_BLANK = "[\\t\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x85\\xa0\u1680\u2000-\u205f\u3000]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TRIM = " :：,，;；|[]()（）"
#: What cleaning takes off a line's ends or sees at its start, and some more: a pattern tries single characters one by one, ranges at once.
_EDGE = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0:,;|\\[\\]()\u1680\u2000-\u205f\u3000\uff08-\uff1b名]"
#: Line ends that aren't plain ones.
_ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029"
ODD_END = f"[{_ODD_ENDS}]"
#: Whether cleaning may change a line.
SPOILT = f"\\A{_EDGE}|[,|#<>]|\\z(?<={_EDGE})"
#: The same of a text between two line ends, of which a line may be empty or end otherwise than plainly: signs and line ends are sought as one.
SPOILT_TEXT = f"[\n,|#<>{_ODD_ENDS}](?:(?<!\n)|(?={_EDGE})|(?<={_EDGE}\n))"

#: Whether a crop has several lines or signs at an end.
SPOILT_CROP = f"[\n{_ODD_ENDS}]|\\A[ :,;|\uff0c-\uff1b]|\\z(?<=[ :,;|\uff0c-\uff1b])"


def alternatives(words) -> str:
    return "|".join(words)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, words) -> Column:
    """Whether one of the words is in a text: a column, or an item that costs nothing to name again.

    Plain searches cost far less than a pattern of alternatives; a word that holds another one says nothing more.
    """
    least = [w for w in words if not any(u != w and u in w for u in words)]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in least])


def has_suffix(c: Column) -> Column:
    """Whether an organisation's suffix is anywhere in a text."""
    return contains_any(c, V.ORG_SUFFIX.split("|"))


def replaced(c: Column, pairs) -> Column:
    """Words replaced one after the other: where there are few to find, far less work than translating each character."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, c)


def normalize(c: Column) -> Column:
    return replaced(c, (("￥", "¥"), ("：", ":"), (" ", "")))


def clean(c: Column) -> Column:
    """A line without blanks and signs around it, cut at rows of signs, without the label of a name.

    The line is named several times: a column, or an item that costs nothing to name again.
    """
    return F.when(c.rlike(SPOILT), _clean(c)).otherwise(c)


def _clean(c: Column) -> Column:
    # few lines have signs or a label, so most go without a regex
    signs = lambda v: F.contains(v, F.lit("|")) | F.contains(v, F.lit("#")) | F.contains(v, F.lit("<")) | F.contains(v, F.lit(">"))
    cut = lambda v: F.when(signs(v), F.get(F.split(v, "[|#<>]{2,}", 2), F.lit(0))).otherwise(v)
    bare = lambda v: F.when(F.startswith(v, F.lit("名")), F.regexp_replace(v, "^(名称|名(?U)\\s*称)[:：]?", "")).otherwise(v)
    return F.btrim(F.replace(let(let(F.btrim(c, F.lit(BLANKS)), cut), bare), F.lit(","), F.lit("")), F.lit(TRIM))


def squeeze(c: Column) -> Column:
    """All white space removed, two signs normalised; null reads as empty."""
    given = F.coalesce(c, F.lit(""))
    return F.when(given.rlike(ODD_BLANK), F.translate(given, "￥：" + BLANKS, "¥:")).otherwise(replaced(given, (("￥", "¥"), ("：", ":"), (" ", ""), ("\n", ""))))


def lines(c: Column) -> Column:
    # a plain end needs no pattern, which would be made anew for each text
    return F.when(c.rlike(ODD_END), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))


def clean_lines(c: Column) -> Column:
    """All lines cleaned, those that clean to nothing too."""
    return F.when(F.concat(F.lit("\n"), c, F.lit("\n")).rlike(SPOILT_TEXT), F.transform(F.split(c, LINE_END), clean)).otherwise(F.split(c, "\n"))


def nonempty(c: Column) -> Column:
    return F.filter(clean_lines(c), lambda x: x != "")


def clean_crop(c: Column) -> Column:
    """Text of a crop: lines cut at signs and blanks, those without text left out; null reads as empty."""
    cut = lambda v: F.array_join(F.filter(F.transform(lines(v), lambda x: F.btrim(x, F.lit(" :：,，;；|"))), lambda x: x != ""), "\n")
    return let(F.coalesce(c, F.lit("")), lambda v: F.when(v.rlike(SPOILT_CROP), cut(v)).otherwise(v))


def first(arr: Column, default: str = "") -> Column:
    return F.coalesce(F.get(arr, F.lit(0)), F.lit(default))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def cjk_only(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{V.CJK}]", "")


def is_person(c: Column) -> Column:
    return let(cjk_only(clean(c)), is_name)


def is_name(name: Column) -> Column:
    return (
        F.when(~F.char_length(name).between(2, 4), False)
        .when(contains_any(name, V.NAME_NOISE) | has_suffix(name), False)
        .when(name.isin(*V.ACCOUNT_NAMES), True)
        .when(F.substring(name, 1, 2).isin(*V.COMPOUND_SURNAMES), F.char_length(name) >= 3)
        .otherwise(F.instr(F.lit(V.SURNAMES), F.substring(name, 1, 1)) > 0)
    )


def is_stamp(c: Column) -> Column:
    return contains_any(c, V.STAMP_NOISE)


def is_company(c: Column) -> Column:
    return (
        (c != "")
        & has_suffix(c)
        & ~is_stamp(c)
        & ~c.isin(*V.BARE_COMPANIES)
        & (F.char_length(c) <= 45)
        & ~contains_any(c, V.BLOCK_WORDS)
        & c.rlike(f"[{V.CJK}A-Za-z0-9（）()]{{2,}}(?:{V.ORG_SUFFIX})")
    )


def is_tax_number(c: Column) -> Column:
    return c.rlike("\\A[0-9A-Z]{12,20}\\z") & ~(c.rlike("\\A[0-9]+\\z") & (F.char_length(c) < 15)) & ~F.contains(c, F.lit("HHE"))


def cents(c: Column) -> Column:
    """Money text to integer cents; null unless it reads as a plain number.

    The text is named several times, as in ``clean``.
    """
    return F.when(c.rlike("\\A[0-9]{1,15}\\.[0-9]{2}\\z"), whole_cents(c)).otherwise(_cents(c))


def whole_cents(c: Column) -> Column:
    """Cents of a number with two decimals, which need no decimal arithmetic; null beyond the range of integers."""
    return F.replace(c, F.lit("."), F.lit("")).try_cast("bigint")


def _cents(c: Column) -> Column:
    plain = F.when(c.rlike("\\A[0-9]{1,15}(\\.[0-9]+)?\\z"), c)
    return F.round(plain.cast("decimal(24,6)") * 100).cast("bigint")


def money(c: Column) -> Column:
    """Integer cents to text with two decimals."""
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def has_money(c: Column) -> Column:
    # what may stand before the digits need not be looked for, and where there is no point there are no cents
    return F.when(~F.contains(c, F.lit(".")), False).otherwise(c.rlike("[0-9]\\.[0-9]"))


def has_checksum(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, "[^0-9]", "")).between(12, 30)


def is_detector_suitable(c: Column) -> Column:
    return let(squeeze(c), lambda t: (t != "") & ~contains_any(t, ("电子发票", "数电", "全电")) & (t.rlike("增.{0,2}税普通发票") | (F.contains(t, F.lit("普通发票")) & F.contains(t, F.lit("发票代码")))))
