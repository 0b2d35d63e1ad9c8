import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyleaf.llm import entry, quality_model, quality_rules, toxicity
from tallyleaf.llm.ftrl import Ftrl

DIR, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return entry.queries()[name](spark, DIR).join(labels, "doc_id").where("held_out").toPandas()


def test_quality_on_held_out_rows(spark):
    p = held_out(spark, "op6_quality", "quality")
    assert (p.predicted == p.y).mean() > 0.97 and p.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    p = held_out(spark, "op2_toxicity", "toxic")
    assert (p.predicted[p.y == 1] == 1).mean() > 0.75 and (p.predicted[p.y == 0] == 1).mean() < 0.02


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    a = quality_model.fit(docs, labels)
    b = quality_model.fit(docs, labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a["w"], b["w"]) and a["bias"] == b["bias"]


def test_swaps_take_weight_from_identity_terms(spark):
    rows = [(k, f"the muslim people are {'vile scum' if k % 2 else 'awful trash'} here") for k in range(60)]
    rows += [(100 + k, f"a quiet walk by the river number{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    probe = spark.createDataFrame([(1, "a muslim by the river"), (2, "a christian by the river")], "doc_id long, text string")
    gap = {}
    for pull in (0.0, 4.0):
        model = toxicity.fit(docs, labels, pull=pull)
        s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
        gap[pull] = abs(s[1] - s[2])
    assert gap[4.0] < gap[0.0] * 0.5


def test_swapped_pairs_stay_in_their_group():
    assert toxicity.swapped("nothing here") == []
    assert len(toxicity.swapped("the german came. two women left")) == len(toxicity.SWAPS["german"]) + len(toxicity.SWAPS["women"])


def test_ftrl_separates():
    rows = [np.array([k % 2, 2 + k % 7]) for k in range(200)]
    w = Ftrl(16).fit(rows, [1.0] * 200, [k % 2 for k in range(200)], 3)
    assert w[1] > 0 > w[0]


@pytest.mark.parametrize("seed", range(3))
def test_rule_counts_equal_brute_force(spark, seed):
    import random
    import re

    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "c|", "é#", "dd"]) + rng.choice(["", "\n", "\n\n"]) for _ in range(rng.randrange(0, 90))) for _ in range(30)]
    texts += ["", "x " * 5000, "\n\n", "a\x0bb\x85c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.apply(df, np.zeros(2 << quality_rules.BITS), 0.0).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_nulls_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "x", 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_model):
        model = module.fit(docs, none)
        got = module.score(docs, model).collect()
        assert len(got) == 3 and all(r.score == 0.5 for r in got)
        assert module.score(docs.limit(0), model).count() == 0
    ratio = quality_rules.fit(docs, none)
    assert not ratio.any() and quality_rules.apply(docs, ratio, 0.0).count() == 3


def ratio_of_all(rows, good):
    """Ratios from counts of every row, good ones as the target."""
    cells, ids = np.zeros((2, 2 << quality_rules.BITS)), quality_rules.Ids()
    for k, t in rows:
        one, two = quality_rules.grams(t or "", ids)
        for target in (0, 1) if k in good else (0,):
            np.add.at(cells[target], one, 1)
            np.add.at(cells[target], two + (1 << quality_rules.BITS), 1)
    out = []
    for c in np.split(cells, 2, axis=1):
        part = c[1].sum() / c[0].sum()
        out.append(np.log((c[1] + 20 * part) / (c[0] + 20)) - np.log(part))
    return np.concatenate(out)


@pytest.mark.parametrize(("n", "block"), [(25_000, None), (60, 7)])
def test_target_is_counted_over_all_good_documents(spark, monkeypatch, n, block):
    if block:
        monkeypatch.setattr(quality_rules, "BLOCK_IDS", block)
    rows = [(k, f"word{k % 97} and part{k % 31} of {k}") for k in range(n)] + [(3, "a second row"), (None, "no id at all"), (5, None)]
    good = set(range(0, n - n // 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in good)) for k in range(n)] + [(0, 1), (None, 1), (n + 9, 1)], "doc_id long, quality int")
    assert np.allclose(quality_rules.fit(docs, labels), ratio_of_all(rows, good), atol=1e-12)
