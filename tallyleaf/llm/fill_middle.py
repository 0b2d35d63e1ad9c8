"""Fill-in-middle transformation: a text is cut into units, and its middle moves to the end.

A unit grammar is a list of pairs of neighbouring character classes between
which one unit ends and the next begins.  It is translated to a regex of zero
width that looks at the two neighbours only; Spark's split at that regex gives
the units, and joined again they are the text.  Where a text is cut, and in
which form it is written, is decided by a hash of its doc_id, so a run anywhere
gives the same result.  All of it is DataFrame expressions on one row: nothing
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "\\x{0}-\\x{10FFFF}"
#: Units end between a character of the left class and one of the right class.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "token": [("^A-Za-z", ANY), ("A-Za-z", "^A-Za-z")],
    "word": [("\\x20\\x09-\\x0D", "^\\x20\\x09-\\x0D")],
    "line": [("\\n", ANY)],
    "character": [(ANY, ANY)],
}
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SHARE = 100


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The regex that matches, without width, between two units."""
    return "|".join(f"(?<=[{left}])(?=[{right}])" for left, right in grammar)


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text in order; none of an empty one, for which split would give one empty piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: str, seed: int, n: int = 4) -> list[Column]:
    """Numbers of 32 bits from the hash of the seed and the doc_id (a null doc_id counts as no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, grammar: str = "token", seed: int = 1, moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """The rows of ``docs`` with n, form, prefix_chars, middle_chars and output.

    ``moved`` per cent of the texts are cut; of those ``suffix_first`` per cent
    have the suffix before the prefix (form spm), the others after it (psm).
    The rest, empty texts and texts that hold a mark are written as they are
    (plain; their prefix_chars and middle_chars are null).  A null text reads
    as empty.  A prefix, a middle or a suffix may be empty.  Equal rows give
    equal results; other columns pass through, save those of these five names,
    which are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws("doc_id", seed)
    cut = docs.withColumn("__text", text).withColumn("__units", units(F.col("__text"), GRAMMARS[grammar]))
    n = F.size("__units")
    cut = cut.withColumns({"__a": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), "__b": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int"), "n": n.cast("long")})
    whole = F.col("__text")
    held = whole.contains(MARKS[0]) | whole.contains(MARKS[1]) | whole.contains(MARKS[2])
    plain = (whole == "") | held | (h3 % SHARE >= moved)
    cut = cut.withColumn("form", F.when(plain, "plain").when(h4 % SHARE < suffix_first, "spm").otherwise("psm"))
    piece = lambda lo, size: F.array_join(F.slice("__units", lo + 1, size), "")
    a, b = F.col("__a"), F.col("__b")
    cut = cut.withColumns({"__p": piece(a * 0, a), "__m": piece(a, b - a), "__s": piece(b, F.size("__units") - b)})
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in zip(MARKS, ("__p", "__s", "__m"), strict=True))
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    out = cut.withColumns({"output": output, "prefix_chars": chars("__p"), "middle_chars": chars("__m")})
    return out.drop("__text", "__units", "__a", "__b", "__p", "__m", "__s")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and the form alone."""
    before, after = (lambda mark: F.substring_index(output, mark, 1)), (lambda c, mark: F.substring_index(c, mark, -1))
    rest = after(output, MARKS[1])
    suffix_last = F.concat(F.replace(before(MARKS[1]), F.lit(MARKS[0])), after(rest, MARKS[2]), F.substring_index(rest, MARKS[2], 1))
    tail = after(output, MARKS[0])
    suffix_lead = F.concat(F.substring_index(tail, MARKS[2], 1), after(tail, MARKS[2]), F.replace(before(MARKS[0]), F.lit(MARKS[1])))
    return F.when(form == "psm", suffix_last).when(form == "spm", suffix_lead).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each row."""
    done = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    number = lambda k: f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT)"
    return f"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
  drawn AS (SELECT *, len(u) AS n, {number(0)} % (len(u) + 1) AS h1, {number(1)} % (len(u) + 1) AS h2, {number(2)} AS h3, {number(3)} AS h4 FROM cut),
  formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:], '') AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM formed"""
