"""Lines of text engines' output, whatever its shape, read as VARIANT.

Engines give a dictionary of parallel lists, a list of such dictionaries, or
lists of [box, [text, score]] nested to any of a few depths; boxes are four
numbers or points.  The output is parsed once, without a schema, and its
lists are unfolded in the row, level by level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of engines, in the order in which they are looked for.
TEXTS, SCORES, BOXES = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_boxes", "rec_polys", "dt_polys", "det_polys", "boxes")
LINE = "struct<text:string,score:double,box:struct<x1:double,y1:double,x2:double,y2:double>>"
#: Lists in lists that are unfolded; output nested deeper is refused.
DEPTH = 5


def at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is looked at."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def elements(v: Column) -> Column:
    """The elements of a list, null for anything else."""
    return at(v, "$", "array<variant>")


def first_present(v: Column, keys: tuple[str, ...], kind: str) -> Column:
    """The first of the lists that is there and not empty."""
    found = F.array(*[at(v, f"$.{k}", f"array<{kind}>") for k in keys])
    return F.coalesce(F.get(F.filter(found, lambda a: F.size(a) > 0), F.lit(0)), F.array().cast(f"array<{kind}>"))


def confidence(text: Column) -> Column:
    """A score as per cent: a share if it is at most 1; what is no number is 0."""
    s = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.round(F.when(s <= 1, s * 100).otherwise(s), 2)


def box_of(v: Column) -> Column:
    """(x1, y1, x2, y2) of four numbers or of at least two points; null for anything else."""
    return once(F.struct(at(v, "$", "array<double>").alias("flat"), at(v, "$", "array<array<double>>").alias("points")), lambda x: box_in(x["flat"], x["points"]))


def box_in(flat: Column, points: Column) -> Column:
    n = lambda k: F.get(flat, F.lit(k))
    side = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    made = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    corners = made(F.least(n(0), n(2)), F.least(n(1), n(3)), F.greatest(n(0), n(2)), F.greatest(n(1), n(3)))
    around = made(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1)))
    numbers = F.forall(flat, lambda x: x.isNotNull())
    whole = F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull()))
    return F.when((F.size(flat) >= 4) & numbers, corners).when((F.size(points) >= 2) & whole, around)


def line(text: Column, score: Column, box: Column) -> Column:
    return F.struct(text.alias("text"), confidence(score).alias("score"), box_of(box).alias("box")).cast(LINE)


def of_dictionary(v: Column) -> Column:
    """Lines of parallel lists, as many as the shorter of texts and scores, then that of a single text."""
    lists = F.struct(first_present(v, TEXTS, "string").alias("t"), first_present(v, SCORES, "string").alias("s"), first_present(v, BOXES, "variant").alias("b"))
    both = lambda x, k: k < F.least(F.size(x["t"]), F.size(x["s"]))
    numbered = once(lists, lambda x: F.transform(x["t"], lambda text, k: F.when(both(x, k), line(text, F.get(x["s"], k), F.get(x["b"], k)))))
    one = at(v, "$.text", "string")
    single = F.when(one != "", F.array(line(one, F.coalesce(at(v, "$.score", "string"), F.lit("0")), at(v, "$.box", "variant"))))
    return F.concat(F.coalesce(numbered, F.array().cast(f"array<{LINE}>")), F.coalesce(single, F.array().cast(f"array<{LINE}>")))


def is_item(v: Column, parts: Column) -> Column:
    """Whether a list, of these elements, is [box, [text, ...]]."""
    return (F.size(parts) == 2) & F.coalesce(F.schema_of_variant(at(v, "$[1][0]", "variant")) == "STRING", F.lit(False))


def unfolded(nodes: Column) -> Column:
    """Lists that are no item give way to their elements."""
    return F.flatten(F.transform(nodes, lambda v: once(elements(v), lambda e: F.when(e.isNotNull() & ~is_item(v, e), e).otherwise(F.array(v)))))


def lines_in(v: Column) -> Column:
    """All lines of an engine's output, in its order, as an array of (text, score, box)."""
    nodes = F.array(v)
    for _ in range(DEPTH):
        nodes = unfolded(nodes)
    item = lambda x: F.array(line(at(x, "$[1][0]", "string"), F.coalesce(at(x, "$[1][1]", "string"), F.lit("0")), at(x, "$[0]", "variant")))
    deeper = F.raise_error(F.lit(f"output nested deeper than {DEPTH} lists")).cast(f"array<{LINE}>")
    read = lambda x: once(elements(x), lambda e: F.when(is_item(x, e), item(x)).when(e.isNotNull(), deeper).otherwise(of_dictionary(x)))
    return F.flatten(F.transform(nodes, read))


def read_output(df: DataFrame, payload: str) -> DataFrame:
    """(doc_id, line_no, text, score, x1, y1, x2, y2) of the lines with text, in the order of the output.

    ``payload`` is JSON text or a VARIANT.  Null and anything that is no
    output (no JSON, a number, an empty list) has no lines; a line without a
    box, or with one that can't be read, has nulls for it.  Blanks around a
    text go, and lines of blanks with them.
    """
    kind = dict(df.dtypes)[payload]
    v = F.col(payload) if kind == "variant" else F.try_parse_json(F.col(payload))
    bare = lambda t: F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")
    kept = F.filter(F.transform(lines_in(v), lambda x: F.struct(bare(x["text"]).alias("text"), x["score"].alias("score"), x["box"].alias("box"))), lambda x: x["text"] != "")
    # outer, or a filter on the array's size would be pushed down and the output read twice
    found = df.select("doc_id", F.posexplode_outer(kept).alias("line_no", "x")).where("x is not null")
    box = [F.col(f"x.box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return found.select("doc_id", "line_no", F.col("x.text").alias("text"), F.col("x.score").alias("score"), *box)
