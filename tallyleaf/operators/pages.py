"""Pages: what lies on a document's page as one array, and choices from it.

The rules of labels, regions and crops look at all lines of one page.  A page
is collected once, into an array of structs; each rule is then a filter and an
extreme over that array, in the same row.  So any number of rules costs one
shuffle, or none if the page came as an array.  An array is as long as a page
has lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]
Keys = Callable[[Column], list[Column]]


def collected(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """(doc_id, name): the rows of each document as an array of structs, in the order of the columns."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def where(items: Column, rule: Rule) -> Column:
    """The items that meet the rule; a null counts as no."""
    return F.filter(items, lambda x: F.coalesce(rule(x), F.lit(False)))


def keyed(items: Column, keys: Keys) -> Column:
    return F.transform(items, lambda x: F.struct(F.struct(*keys(x)).alias("keys"), x.alias("item")))


def first_by(items: Column, keys: Keys) -> Column:
    """The item of the least keys, of equals the one whose fields come first; null if there is none."""
    return F.array_min(keyed(items, keys))["item"]


def last_by(items: Column, keys: Keys) -> Column:
    """The item of the greatest keys, of equals the one whose fields come last."""
    return F.array_max(keyed(items, keys))["item"]


def pairs(left: Column, right: Column, rule: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of all pairs that meet the rule, as one array."""
    return F.flatten(F.transform(left, lambda a: F.transform(where(right, lambda b: rule(a, b)), lambda b: make(a, b))))


def nearest(labels: Column, values: Column, rule: Callable[[Column, Column], Column], distance: Callable[[Column, Column], Column], number: str = "line_no") -> Column:
    """The value at the least distance from a label; of equals that of the first label, then the first value."""
    made = pairs(labels, values, rule, lambda a, b: F.struct(distance(a, b).alias("d"), a[number].alias("l"), b[number].alias("v"), b.alias("item")))
    return F.array_min(made)["item"]


def beside(y_window: float, below: bool = True) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]:
    """(rule, distance) of a value on the row of its label or under it."""
    row = lambda a, b: (F.abs(b["cy"] - a["cy"]) <= y_window) & (b["cx"] >= a["cx"] - 40)
    under = lambda a, b: F.lit(below) & (b["cy"] > a["cy"]) & (b["cy"] - a["cy"] <= 2 * y_window) & (F.abs(b["cx"] - a["cx"]) <= 320)
    rule = lambda a, b: (a["line_no"] != b["line_no"]) & (row(a, b) | under(a, b))
    return rule, lambda a, b: F.abs(b["cy"] - a["cy"]) + F.greatest(F.lit(0.0), b["cx"] - a["cx"]) + F.when(row(a, b), 0).otherwise(120)


def in_column(height: float) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]:
    """(rule, distance) of a value under its label."""
    dx = lambda a, b: F.abs(b["cx"] - a["cx"])
    rule = lambda a, b: (b["cy"] > a["cy"]) & (b["cy"] - a["cy"] <= 0.42 * height) & (dx(a, b) <= 150)
    return rule, lambda a, b: 2 * dx(a, b) + F.abs(b["cy"] - a["cy"])
