import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillwatch.llm import sieve, substring


def brute_force(texts: list[str | None], window: int) -> pd.DataFrame:
    """The same rule on a few texts, by counting every window."""
    split = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for ws in split:
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i:i + window])] = seen.get(tuple(ws[i:i + window]), 0) + 1
    rows = []
    for ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] > 1:
                gone.update(range(i, i + window))
        rows.append((len(ws), len(gone), b" ".join(x for i, x in enumerate(ws) if i not in gone).decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def frame(spark, texts, extra=True):
    rows = [(i, t, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, starts string, place string").repartition(3)


def check(spark, texts, window):
    got = substring.remove_repeats(frame(spark, texts), window).orderBy("doc_id").toPandas()
    want = brute_force(texts, window)
    assert got[["n_words", "n_removed", "kept"]].values.tolist() == want.values.tolist()


def test_against_brute_force(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = [rnd.choice("abcdefgh") + rnd.choice("xyzé") for _ in range(rnd.randint(0, 120))]
        if i % 3 == 0:
            a, n = rnd.randint(0, 24), rnd.randint(30, 60)
            w[rnd.randint(0, len(w)):0] = passage[a:a + n]
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
    texts += [texts[3], texts[3], None, "", " \t", "one", " ".join(["same"] * 90), " ".join(passage), " ".join(passage)]
    check(spark, texts, 35)
    check(spark, texts, 4)
    check(spark, texts, 1)


def test_empty_table_and_repeated_rows(spark):
    assert substring.remove_repeats(frame(spark, []).where("false")).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    twice = spark.createDataFrame([(1, text), (1, text), (None, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in substring.remove_repeats(twice).collect()}
    assert got == {(1, 40), (None, 0)}


def test_cover_reaches_every_difference():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_rows_without_id_whose_texts_share_a_32_bit_hash(spark):
    """Two unrelated texts with the same Spark hash: the repeat in one takes no words from the other."""
    one, two = (" ".join(f"w{i}x{j}" for j in range(40)) for i in (23147, 205656))
    table = spark.createDataFrame([(None, one), (None, two), (9, one + " end")], "doc_id long, text string")
    assert table.where("doc_id is null").selectExpr("hash(text) as h").distinct().count() == 1
    got = {r.text: (r.n_removed, r.kept) for r in substring.remove_repeats(table).collect()}
    assert got == {one: (40, ""), two: (0, two), one + " end": (40, "end")}


def test_equal_rows_without_id_share_one_list_of_spans(spark):
    text = " ".join(f"w{i}" for i in range(200))
    table = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    spans = substring.repeated_spans(table).collect()
    assert len(spans) == 1 and len(spans[0].starts) <= 200
    assert substring.remove_repeats(table).where("n_removed = 200 AND kept = ''").count() == 4000


def test_passage_in_many_texts_that_differ_around_it(spark):
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"a{i}x{j}" for j in range(rnd.randint(0, 30))] + passage + [f"b{i}x{j}" for j in range(rnd.randint(0, 30))]) for i in range(300)]
    check(spark, texts, 35)


def test_all_columns_come_back(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1, 2, 3, 4), (2, text + " end", "b", 5, 6, 7, 8), (3, "un touched  text", "c", 9, 10, 11, 12), (4, None, None, None, None, None, None)]
    names = ["doc_id", "text", "kept", "starts", "key_high", "c0", "n_chars"]
    got = sorted(tuple(r) for r in substring.with_repeats_removed(spark.createDataFrame(rows, names)).collect())
    assert got == [(1, "", "a", 1, 2, 3, 0), (2, "end", "b", 5, 6, 7, 3), *rows[2:]]


def test_a_bit_table_holds_every_member():
    rng = np.random.default_rng(1)
    table = np.zeros(sieve.BITS // 64, np.uint64)
    assert not sieve.may_hold(table, rng.integers(-2**63, 2**63 - 1, 10)).any()


def test_bit_table_of_a_column(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-2**63, 2**63 - 1, 5000)
    table = sieve.sieve(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert sieve.may_hold(table, keys).all()
    assert sieve.may_hold(table, rng.integers(-2**63, 2**63 - 1, 5000)).sum() < 5
