import math
import re
from collections import Counter

import pytest
from oracle_check import compare, connect

from tillwatch.llm import rules as R
from tillwatch.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, n_words string, kept int"
LABELS = "doc_id long, quality int, toxic int"
GOOD = " ".join(f"word{i} and other{i}" for i in range(30))


def counts_of(text):
    """The counts by plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(re.findall("[A-Z]", text)), len(lines), len(lines) - len(set(lines)),
            len(inside))


TEXTS = [None, "", " \n\t ", "a", "é ü\n\né ü\r\né ü", "a b c a b c", "a a a a", "x\ny\nx\n", "\n\nx\n\n", "# * $%&|<> ##", "日本 語\x0b語 日本 語", "ABC def Ä",
         "a b c d a b c", "w " * 30000, "\n".join(["same line here", "other"] * 50)]


def test_counts_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in R.COUNTS) for r in R.text_counts(df).collect()}
    assert got == {i: counts_of(t) for i, t in enumerate(TEXTS)}


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.3), (200, 0, 0.0125), (500, 7, 0.02), (50, 50, 0.1)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert R.at_most(k, n, p) == pytest.approx(want, rel=1e-9)
    assert R.at_most(100, 10**7, 0.0125) == 0.0 and R.at_most(125_000, 10**7, 0.0125) == pytest.approx(0.5, abs=0.01)


def corpus(n_good, n_bad, noisy_good, lang="en", first=0):
    """Good texts, some with many symbols, and low-quality texts with many symbols: (documents, labels)."""
    noisy = GOOD.replace("and", "&&&&&&&&")
    docs = [(first + i, noisy if i < noisy_good else GOOD, lang) for i in range(n_good)] + [(first + n_good + i, noisy, lang) for i in range(n_bad)]
    return docs, [(d, int(i < n_good), 0) for i, (d, _, _) in enumerate(docs)]


def judged(spark, docs, labels, **kw):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], SCHEMA)
    return {r.doc_id: r for r in R.judge(d, spark.createDataFrame(labels, LABELS), **kw).collect()}


def test_a_cutoff_needs_enough_labels_and_few_false_rejections(spark):
    docs, labels = corpus(600, 60, 0)
    kept = {k for k, r in judged(spark, docs, labels).items() if r.kept}
    assert kept == set(range(600))  # (1 - 0.0125) ** 600 is below 0.05 / 4
    docs, labels = corpus(300, 60, 0)
    assert all(r.kept for r in judged(spark, docs, labels).values())  # too few labels to be sure
    docs, labels = corpus(600, 60, 20)
    assert all(r.kept for r in judged(spark, docs, labels).values())  # 20 of 600 good ones would go
    assert R.at_most(20, 600, R.RISK / 4) > R.ERROR / 4 >= R.at_most(0, 600, R.RISK / 4)


def test_strata_are_tested_apart_and_corrected(spark):
    one, two = corpus(600, 60, 0), corpus(360, 60, 0, "de", 5000)
    got = judged(spark, one[0] + two[0], one[1] + two[1])
    # 360 good ones pass at 0.05 / 4, not at 0.05 / 8
    assert R.ERROR / 8 < R.at_most(0, 360, R.RISK / 4) <= R.ERROR / 4
    assert not got[600].kept and got[600].reasons == ["symbols"] and got[5360].kept


def test_nulls_repeats_and_conflicting_labels(spark):
    docs, labels = corpus(600, 60, 0)
    docs += [(None, GOOD.replace("and", "&&&&&&&&"), "en"), (7, GOOD, "en"), (None, None, None), (9001, "", "xx"), (9002, GOOD, None)]
    labels += [(None, 0, 0), (3, None, 0), (599, 0, 0), (77777, 1, 0)]
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], SCHEMA)
    rows = R.judge(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    none = [r for r in rows if r.doc_id is None]
    assert sorted((r.base_failed, r.kept, r.stratum) for r in none) == [(False, False, "en"), (True, False, "und")]
    assert sum(r.kept for r in rows if r.doc_id == 7) == 2
    last = {r.doc_id: r for r in rows}
    assert last[9001].base_failed and last[9002].kept and last[599].kept


def test_empty_tables(spark):
    docs, labels = corpus(5, 0, 0)
    assert judged(spark, [], labels) == {} and all(r.kept for r in judged(spark, docs, []).values())


def test_equal_to_sql_with_certified_cutoffs(spark):
    """The larger test data has enough labels for some cutoffs."""
    folder = "/root/testdata/sf0.1"
    out = QUERIES["op12_quality_rules"](spark, folder).cache()
    message, _ = compare(out, connect(folder), SQL["op12_quality_rules"])
    assert message == "" and out.where("reasons != ''").count() > 100


def test_false_rejections_stay_within_the_risk(spark):
    """Labels of half the documents set the cutoffs, the others show what they reject."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = R.judge(docs, labels.where("doc_id % 2 = 0"))
    other = out.join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").where("NOT base_failed").selectExpr("count(*)", "count_if(not kept)").first()
    assert other[0] > 500 and other[1] <= R.RISK * other[0]
