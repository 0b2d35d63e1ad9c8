"""Hand-traced cases of the extractors and of the record."""

import pytest
from pyspark.sql import functions as F

from tallyleaf.functions import extract as X
from tallyleaf.functions import text as T
from tallyleaf.operators import fusion, validate


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("  名称: 某某公司 ", "某某公司"), ("甲||乙", "甲"), ("1,234.50", "1234.50"), ("[x]", "x"), ("", ""), ("|a|", "a")],
)
def test_clean(spark, text, want):
    assert value(spark, T.clean, text) == want


@pytest.mark.parametrize(("name", "want"), [("王小明", True), ("李", False), ("欧阳", False), ("欧阳明", True), ("某公司", False), ("管理员", True), ("购买方", False), ("叁拾", False)])
def test_person(spark, name, want):
    assert value(spark, T.is_person, name) is want


@pytest.mark.parametrize(("text", "want"), [("2023-13-01", ""), ("2023-1-5", "2023年01月05日"), ("20230105", "2023年01月05日"), ("1999-01-05", ""), ("", "")])
def test_date(spark, text, want):
    assert value(spark, X.fallback_date, text) == want


@pytest.mark.parametrize(("text", "want"), [("a¥1,234.50b", ["1234.50"]), ("12345", []), ("0.00 3.10", ["3.10"]), ("1.23.45", ["1.23"]), ("5.00 5.00", ["5.00"])])
def test_money(spark, text, want):
    assert value(spark, X.money_candidates, text) == want


def test_code_prefers_the_later_twin(spark):
    assert value(spark, X.fallback_code, "1100123456 x 9900123456 y 1100123457") == "1100123457"


def test_two_sum_tolerates_a_cent(spark):
    split = lambda t: X.infer_amount_tax(t, F.lit("100.01"))
    assert tuple(value(spark, split, "94.34 5.66 100.01")) == (9434, 566)
    assert value(spark, split, "94.34 5.60 100.01") is None
    assert tuple(value(spark, split, "税率6%")) == (9435, 566)


def test_tail_drawer_state_machine(spark):
    tail = lambda t: X.drawer_in_tail(F.split(t, "/"))
    assert value(spark, tail, "王小明/¥12.00/李芳/张三") == "李芳"
    assert value(spark, tail, "¥12.00/某某公司/李芳") == ""
    assert value(spark, tail, "李芳") == ""


def test_agent_name_in_pieces(spark):
    assert value(spark, X.agent_name, "代开企业名称:\n备注\n王小明\n地址") == "王小明"
    assert value(spark, X.agent_name, "代开企业名称:\n地址\n王小明") == ""


def test_empty_and_null_texts(spark):
    rec = fusion.parse(spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id int, text string")).collect()
    assert all(r[f] == "" for r in rec for f in fusion.V.FIELDS)


@pytest.mark.parametrize(("total", "want"), [("100.00", "ok"), ("100.02", "ok"), ("100.03", "warning"), ("", None)])
def test_amount_identity_at_its_edge(spark, total, want):
    row = {f: "" for f in fusion.V.FIELDS} | {"amount": "94.00", "tax": "6.00", "total": total}
    checks = validate.validate(spark.createDataFrame([row])).first().checks
    assert checks.total.level == (want or "missing")


def test_tax_id_levels(spark):
    row = {f: "" for f in fusion.V.FIELDS}
    checks = validate.validate(spark.createDataFrame([row | {"seller_tax_id": "9" * 18, "invoice_type": "增值税普通发票"}])).first().checks
    assert checks.seller_tax_id.level == "warning" and checks.buyer_tax_id.level == "optional"
