import hashlib
import re

import pytest

from tallyleaf.llm import fill_middle as M

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
UNITS = {"token": TOKEN, "line": re.compile(r"[^\n]*\n|[^\n]+"), "character": re.compile(r"(?s)."), "word": re.compile(r"(?a:\s*\S+\s*)|\s+")}
SCHEMA = "doc_id long, text string, n string, __text2 int"
TEXTS = ["", None, "a", "one", "two words", "x1y22 zz.", "a😀b😀😀cd 語 é\r\n\tq", "has <P> in it", "has <S>", "<M>", "< P>", "<<S", "M> <", "a\nb\n\nc", " lead and trail ", "word " * 30_000, "é" * 50, "\n" * 40]


def rows():
    out = [(k, t, "clash", k) for k, t in enumerate(TEXTS * 12)]
    return out + [(None, "no id here", "x", 1), (None, "no id here", "x", 1), (7, "a row", "x", 2), (7, "a row", "x", 2), (-3, "minus id", "x", 3)]


def brute(doc_id, text):
    text = text or ""
    u = TOKEN.findall(text)
    n = len(u)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force_and_restores(spark):
    data = rows()
    done = M.fill_in_middle(spark.createDataFrame(data, SCHEMA))
    assert done.columns.count("n") == 1 and "__text2" in done.columns
    got = done.withColumn("back", M.restored(done.output, done.form)).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((brute(*r[:2]) for r in data), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digest(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t, *_ in rows() if i is not None and brute(i, t)[2] != "plain")
    assert sorted(tuple(r) for r in M.digest(docs).where("doc_id is not null and form <> 'plain'").collect()) == want
    assert M.digest(docs.limit(0)).count() == 0
    assert "Exchange" not in M.digest(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grammar", sorted(M.GRAMMARS))
def test_units_of_each_grammar(spark, grammar):
    from pyspark.sql import functions as F

    texts = [t for t in TEXTS if t is not None and len(t) < 1000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.u for r in docs.select("text", M.units(F.col("text"), M.GRAMMARS[grammar]).alias("u")).collect()}
    for t in texts:
        assert "".join(got[t]) == t
        if grammar != "word":
            assert got[t] == UNITS[grammar].findall(t)
    if grammar == "word":
        assert got[" lead and trail "] == [" ", "lead ", "and ", "trail "]


def test_shares_are_parameters(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('some text of row ', id) as text")
    assert M.fill_in_middle(docs, moved=0).where("form <> 'plain'").count() == 0
    assert M.fill_in_middle(docs, moved=100, suffix_first=100).where("form <> 'spm'").count() == 0
    assert 300 < M.fill_in_middle(docs, seed=5).where("form <> 'plain'").count() < 400
