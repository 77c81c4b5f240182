import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tillwatch.llm import language

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "ßéñöüxyz"}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(LETTERS))
        words = ["".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(1, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(600) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 456 !", "bb"), (1003, "abc " * 30_000, None), (1004, "z", None)]
    docs = spark.createDataFrame([(*r, "s", 0.1) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(3)
    got = {r.doc_id: r for r in language.identify(docs).select("*", language.held_out().alias("held")).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, lang) for i, t, lang in rows[:600] if got[i].held]
    assert len(held) > 150 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and 0 < got[1003].score <= 1 and got[1004].lang_pred in LETTERS
    assert sum(got[i].rejected for i in range(600)) <= 12


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark):
    docs = spark.createDataFrame(corpus(150), "doc_id long, text string, lang string")
    spoiled = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(d).collect()} for d in (docs, spoiled))
    assert one == two


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in language.identify(docs).collect()] == [("und", 0.0, True)] * 2
    assert language.identify(docs.where("false")).count() == 0


def test_grams_of_a_word():
    grams, first = language.word_grams([b"ab", b"c"])
    assert first.tolist() == [0, 2 + 3 + 2 + 1, 8 + 1 + 2 + 1]
    assert grams[:8].tolist() == language.word_grams([b"AB"])[0].tolist()


def test_many_labels_take_little_memory():
    rnd = random.Random(3)
    languages = [f"l{i}" for i in range(200)]
    model = language.Model(languages, np.random.default_rng(1).normal(size=(language.BUCKETS, 200)).astype(np.float32), np.zeros(200))
    words = list({bytes(rnd.choice(b"abcdefghijklmnop") for _ in range(8)) for _ in range(50_000)})
    tracemalloc.start()
    sums, sizes = model.word_logits(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20 and sums.nbytes > 35 << 20
    grams, _ = language.word_grams(words[41_000:41_001])
    assert np.allclose(sums[41_000], model.logits[grams].sum(axis=0), atol=1e-3) and sizes[41_000] == len(grams)


def test_unlearned_languages_are_rejected_and_clean_texts_stay(spark):
    strange = ["Добежать до конца страницы и вернуться обратно, чтобы прочитать все снова. " * 5, "日本語のテキストはここにあります。" * 10,
               "def f(x):\n    return x[1:] if len(x) > 3 else None\nfor i in range(10): print(f(i))\n" * 3, "xqzt vbnk qwrt zzkj pqxv " * 20]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 != 2").withColumn("__has", F.lit("x"))
    more = spark.createDataFrame([(10**9 + i, t, "x") for i, t in enumerate(strange)], "doc_id long, text string, __has string")
    found = language.identify(docs.unionByName(more, True), ("doc_id", "lang", "score", "__has")).withColumn("held", language.held_out()).toPandas()
    assert "__has" in found and found["score"].between(0, 1).all()
    assert found[found["doc_id"] >= 10**9]["rejected"].all()
    clean = found[found["held"] & found["lang"].notna() & (found["lang_pred"] != "und")]
    assert clean["rejected"].mean() < 0.005 and (clean["lang"] == clean["lang_pred"]).mean() > 0.99


def test_rows_without_or_with_the_same_id_are_learned_from(spark):
    rows = [(None, t, m) for _, t, m in corpus(90)] + [(5, "ab ba abab", "aa")] * 500
    texts, langs = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(texts) == len(set(zip(texts, langs))) == len({(t, m) for _, t, m in rows})
