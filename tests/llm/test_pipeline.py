import random

import corpus_pipeline


def test_stages_in_order_on_a_small_corpus(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "substring_dedup", "pii", "packing"]
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(50))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(60))
        rows.append((i, f"{text} {passage} {word()}" if i in (5, 9) else text, "en"))
    rows += [(100, rows[1][1], "en"), (101, rows[2][1].replace(rows[2][1].split()[3], "zz", 1) + " q", "en"), (102, "123 456", "en"), (103, None, None),
             (104, "mail me: jo@example.org at 10.0.0.7\nplease " + word(), "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {102, 103} & set(seen["language_id"]) and len(seen["language_id"]) == 63
    assert set(seen["language_id"]) - set(seen["near_duplicates"]) == {100, 101}
    kept = seen["substring_dedup"]
    assert passage not in kept[5].text and passage not in kept[9].text and kept[5].n_chars == len(kept[5].text)
    assert all(kept[i].text == rows[i][1] for i in range(60) if i not in (5, 9))
    assert "jo@example.org" not in seen["pii"][104].text and "10.0.0.7" not in seen["pii"][104].text and "\nplease" in seen["pii"][104].text
    assert seen["pii"][7] == kept[7]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(packed.doc_id) == set(kept)


def test_odd_rows_and_further_columns(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(60)), "en") for i in range(20)]
    long = " ".join(f"{word()}{i}" for i in range(20_000))
    rows += [rows[3], rows[3], (None, " ".join(word() for _ in range(60)), "en"), (50, long, "en"), (51, None, "en"), (52, "", None), (53, " \n", "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), 1, "k", 0.5) for i, t, x in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, key_high string, score double").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    left = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == [*[(False, i) for i in range(20)], (False, 50), (True, 0)]
    assert {r.doc_id: r.text for r in left}[50] == long
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert packed.groupby(packed.doc_id.fillna(-1)).length.sum().to_dict()[50] == packed[packed.doc_id == 50].doc_tokens.iloc[0] > 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
