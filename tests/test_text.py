"""Passages, search, grounding and result comparison."""

import math
import random
import re
import time
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from paths import SF
from pyspark.sql import functions as F

from tillwatch.operators import grounding, search, text
from tillwatch.plans import catalog
from tillwatch.session import SPARING, sparing


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, label string, text string")


def test_heading_path_and_code_comments(spark):
    body = ("# Guide\n\n## 1. Setup\nInstall the tools and then run the command shown below here.\n"
            "```bash\n# a comment, not a heading\npip install -r list.txt\n```\n"
            "### 1.1 Check\nRun the tests to make sure that everything works as expected.\n")
    out = text.chunk_markdown(docs(spark, ("x.md", "X", body))).orderBy("section").collect()
    assert [r["title"] for r in out] == ["1. Setup", "1. Setup › 1.1 Check"]
    assert "# a comment" in out[0]["text"] and "```bash" in out[0]["text"]
    long = "This sentence is certainly longer than forty characters, is it not?"
    shallow = f"{long}\n# Top\n{long}\n##### five\n{long}\n## A\nshort\n# Next\n{long}\r\n"
    out = text.chunk_markdown(docs(spark, ("y.md", "Y", shallow))).orderBy("section").collect()
    assert [r["title"] for r in out] == ["Y", "Top", "Next"] and "##### five" in out[1]["text"]


def test_long_section_is_split_without_losing_text(spark):
    paras = [f"Paragraph {i}: " + "content " * 40 for i in range(8)]
    out = text.chunk_markdown(docs(spark, ("a.md", "A", "## Long\n" + "\n\n".join(paras)))).collect()
    assert len(out) > 1 and all(len(r["text"]) <= text.MAX_CHARS for r in out)
    assert sum(len(re.findall("Paragraph", r["text"])) for r in out) == 8
    huge = "x" * 2000
    out = text.chunk_markdown(docs(spark, ("b.md", "B", f"{huge}\n\nend"))).orderBy("part").collect()
    assert [r["text"] for r in out] == [huge, "end"]


def test_refresh_keeps_only_current_passages(spark):
    p = text.chunk_markdown(docs(spark, ("a", "A", "a" * 50), ("b", "B", "b" * 50)))
    keys = {r["source"]: r["key"] for r in p.collect()}
    stored = spark.createDataFrame([(keys["a"], 1), ("gone", 2)], "key string, vector int")
    new, kept = text.refresh(p, stored)
    assert [r["source"] for r in new.collect()] == ["b"] and [r["key"] for r in kept.collect()] == [keys["a"]]


def test_keyword_scores_against_plain_python(spark):
    data = {1: "pay with the app", 2: "the bank did not answer", 3: "Pay pay PAY again"}
    query = "pay the bank"
    d = spark.createDataFrame(list(data.items()), "doc_id bigint, text string")
    q = spark.createDataFrame([(1, query)], "item_id bigint, text string")

    def grams(t):
        w = t.lower().split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    df = {}
    for t in data.values():
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1

    def vector(t):
        g = grams(t)
        v = {x: (1 + math.log(g.count(x))) * (math.log((1 + len(data)) / (1 + df[x])) + 1) for x in set(g) if x in df}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / n for k, x in v.items()}
    qv = vector(query)
    want = {k: round(sum(qv.get(g, 0) * x for g, x in vector(t).items()), 6) for k, t in data.items()}
    got = {r["doc_id"]: r["score"] for r in text.keyword_scores(d, q, "doc_id", "item_id").collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-6)


def test_fusion_equals_brute_force(spark):
    """150 documents, so that most lie below the inspected heads of both lists."""
    n = 150
    kw = {d: (d * 37 % 101) / 101 for d in range(n) if d % 3}
    vec = {d: (d * 53 % 149) / 149 for d in range(n)}
    order = lambda s: {d: i for i, d in enumerate(sorted(s, key=lambda d: (-s[d], d)), 1)}
    rk, rv = order(kw), order(vec)
    full = {d: round(1 / (rk.get(d, len(kw) + 1) + 60) + 1 / (rv[d] + 60), 9) for d in range(n)}
    want = sorted(full, key=lambda d: (-full[d], d))[:6]
    frame = lambda s: spark.createDataFrame([(1, d, x) for d, x in s.items()], "q bigint, d bigint, score double")
    got = text.fuse(frame(kw), frame(vec), "q", "d").orderBy("rank").collect()
    assert [r["d"] for r in got] == want
    assert [r["keyword_rank"] for r in got] == [rk.get(d, len(kw) + 1) for d in want]


def test_fusion_keeps_documents_and_queries_without_vector(spark):
    """Query 1 has a vector, 2 has none, 3 has neither vector nor words; 146 documents have no vector, 20 no words."""
    n = 150
    kw = {1: {d: (d * 37 % 101) / 101 for d in range(n - 20)}, 2: {d: (d * 41 % 103) / 103 for d in (7, 90, 120)}, 3: {}}
    vec = {1: {d: (d * 53 % 149) / 149 for d in range(n) if d >= 146}, 2: {}, 3: {}}
    order = lambda s: {d: i for i, d in enumerate(sorted(s, key=lambda d: (-s[d], d)), 1)}
    want = {}
    for q in kw:
        rk, rv = order(kw[q]), order(vec[q])
        full = {d: round(1 / (rk.get(d, len(rk) + 1) + 60) + (1 / (rv[d] + 60) if d in rv else 0), 9) for d in range(n)}
        want[q] = [(d, full[d], rv.get(d)) for d in sorted(full, key=lambda d: (-full[d], d))[:6]]
    frame = lambda s: spark.createDataFrame([(q, d, x) for q in s for d, x in s[q].items()], "q bigint, d bigint, score double")
    queries, every = spark.createDataFrame([(q,) for q in kw], "q bigint"), spark.createDataFrame([(d,) for d in range(n)], "d bigint")
    got = text.fuse(frame(kw), frame(vec), "q", "d", queries=queries, docs=every).orderBy("q", "rank").collect()
    assert {q: [(r["d"], r["score"], r["vector_rank"]) for r in got if r["q"] == q] for q in kw} == want
    assert any(v is None for _, _, v in want[1])


def test_vector_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "d bigint, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "q bigint, embedding array<float>")
    out = text.vector_scores(v, q, "d", "q", block=2, salts=3)
    assert out.count() == 140 and out.where(F.col("score") != F.col("d") + F.col("q")).count() == 0


def test_invented_numbers_are_found(spark):
    rows = [("AUC 0.93 [1].", ["AUC 0.77 and 0.75"]), ("25,000 people, 9.1% [2, 3], 3 things", ["25,000 of them; 9.1"]), ("no numbers", ["x"])]
    df = spark.createDataFrame(rows, "answer string, evidence array<string>")
    out = df.select(grounding.ungrounded_numbers("answer", F.col("evidence")).alias("u")).collect()
    assert [r["u"] for r in out] == [["0.93"], [], []]


def test_citations_and_grades(spark):
    df = spark.createDataFrame([([3, 99, 1, 3, 0],)], "c array<int>")
    assert df.select(grounding.valid_citations("c", F.lit(6)).alias("v")).first()["v"] == [1, 3]
    a = spark.createDataFrame([
        (1, "answered", [1], "Use App Password", ["docs"], ["app password"]), (2, "answered", [], "app password", ["docs"], ["app password"]),
        (3, "answered", [1], "something", ["docs"], ["app password"]), (4, "not_found", [], None, [], []), (5, "answered", [1], "x", [], [])],
        "id int, status string, citations array<int>, answer string, sources array<string>, must_include array<string>")
    graded = grounding.grade_answers(a)
    assert {r["id"]: r["correct"] for r in graded.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert grounding.share_correct(graded).first()["share"] == 0.4


def test_result_sets(spark):
    gold = spark.createDataFrame([("a", 0.12345), ("b", 2.0)], "k string, v double")
    match = lambda p: grounding.results_match(gold, p).first()["match"]
    wide = spark.createDataFrame([(2.0, "b", 7), (0.1234, "a", 8)], "x double, y string, z int")
    assert match(spark.createDataFrame([(0.1233, "a", 1), (2.0, "b", 7)], "x double, y string, z int")) is True
    assert match(wide) is True
    assert match(spark.createDataFrame([("a", 0.5), ("b", 2.0)], "k string, v double")) is False
    assert match(spark.createDataFrame([("a", 0.123), ("b", 2.0), ("b", 2.0)], "k string, v double")) is False
    twice = spark.createDataFrame([("a", 0.123), ("a", 0.123)], "k string, v double")
    assert grounding.results_match(twice, gold).first()["match"] is False
    apart = spark.createDataFrame([("a",), ("b",)], "k string")
    assert grounding.results_match(apart, spark.createDataFrame([("a", "b"), ("c", "c")], "x string, y string")).first()["match"] is False
    none = apart.where("false")
    assert grounding.results_match(none, none).first()["match"] is True and grounding.results_match(none, apart).first()["match"] is False


def can_match(gold, predicted):
    """Some order of the predicted rows has every gold row inside its own."""
    return len(gold) == len(predicted) and any(all(g <= p for g, p in zip(gold, order)) for order in permutations(predicted))


def test_matching_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = lambda n, least, most: [frozenset(rnd.sample("abcde", rnd.randint(least, most))) for _ in range(n)]
    cases = []
    for _ in range(300):
        n = rnd.randint(0, 5)
        gold = rows(n, 1, 2)
        cases.append((gold, [g | r for g, r in zip(gold, rows(n, 0, 2))] if rnd.random() < .4 else rows(n if rnd.random() < .9 else n + 1, 2, 4)))
    tables = [spark.createDataFrame([(i, sorted(r)) for i, c in enumerate(cases) for r in c[side]], "case int, row array<string>") for side in (0, 1)]
    got = {r["case"]: r["match"] for r in grounding.match_cases(*tables).collect()}
    want = {i: can_match(*c) for i, c in enumerate(cases) if c[0] or c[1]}
    assert got == want and 80 < sum(want.values()) < 260


def test_ambiguous_rows_are_solved_by_augmenting_paths():
    rnd = random.Random(12)
    for _ in range(200):
        edges = {g: rnd.sample(range(4), rnd.randint(1, 4)) for g in range(4)}
        need, room = {g: rnd.randint(1, 3) for g in edges}, {p: rnd.randint(0, 4) for p in range(4)}
        units = [g for g in edges for _ in range(need[g])]
        slots = [p for p in room for _ in range(room[p])]

        def place(i, free):
            return i == len(units) or any(place(i + 1, free - {k}) for k in {slots[k]: k for k in free if slots[k] in edges[units[i]]}.values())
        assert grounding._augment(need, dict(room), edges) == place(0, frozenset(range(len(slots))))


def test_postings_follow_their_passages(spark, tmp_path):
    frame = lambda **texts: spark.createDataFrame(sorted(texts.items()), "key string, text string")
    store = search.PostingsStore(spark, str(tmp_path / "index"))
    there = lambda: sorted((r["key"], r["term"], r["n"]) for r in store.postings().where("term NOT LIKE '% %'").collect())
    store.refresh(frame(a="one two one", b="two"), 1)
    assert there() == [("a", "one", 2), ("a", "two", 1), ("b", "two", 1)]
    for _ in range(2):  # a repeated version replaces itself
        store.refresh(frame(b="two", c="six"), 2)
        assert there() == [("b", "two", 1), ("c", "six", 1)]
    store.refresh(frame(a="one two one", b="two"), 3)
    assert there() == [("a", "one", 2), ("a", "two", 1), ("b", "two", 1)]
    store.refresh(frame(a="x").where("false"), 4)
    assert there() == []


def test_keyword_search_keeps_one_row_per_document(spark, monkeypatch):
    """Terms never leave their document one by one; frequent terms are sent, the others joined, and blocks are cut by their terms."""
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    d = spark.createDataFrame([(i, some(30)) for i in range(40)] + [(3, some(5)), (50, None), (51, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, some(4)) for i in range(9)] + [(9, "nothing known")], "item_id bigint, text string")
    want = {(r["item_id"], r["doc_id"]): r["score"] for r in text.keyword_scores(d, q, "doc_id", "item_id").collect()}
    for sent in (0, 12, 1000):
        monkeypatch.setattr(search, "SENT_TERMS", sent)
        monkeypatch.setattr(search, "TERM_BLOCK", 200)
        monkeypatch.setattr(search, "WORD_QUERY_BLOCK", 4)
        words = search.Keywords(d, q, "doc_id", "item_id")
        assert words.doc_blocks > 1 and words.query_blocks == 3 and words.rows.count() == 40 * 3
        got = {(r["item_id"], r["doc_id"]): r["score"] for r in search.best(words, 100).collect()}
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-6)


def test_longer_texts_mean_more_tasks_of_terms(spark, monkeypatch):
    """What cuts, counts and looks up terms gets a task for every TASK_CHARS characters, and a task adds up no more than HELD_TERMS at a time."""
    rnd = random.Random(6)
    some = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    rows = [(i, some(40)) for i in range(80)] + [(7, some(9)), (90, None), (91, "")]
    d, q = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, some(6)) for i in range(5)], "item_id bigint, text string")
    files, tasks, store = {}, -(-sum(len(t or "") for _, t in rows) // 500), search.write_shared

    def stored(df, name):
        out = store(df, name)
        files[name] = len(out.inputFiles())
        return out
    monkeypatch.setattr(search, "write_shared", stored)
    monkeypatch.setattr(search, "TASK_CHARS", 500)
    monkeypatch.setattr(search, "HELD_TERMS", 50)
    monkeypatch.setattr(search, "SENT_TERMS", 100)
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in search.best(search.Keywords(d, q, "doc_id", "item_id"), 100).collect()}
    assert files["idf"] == tasks > 20 and files["looked-up"] > 15  # files hold rows: a few of the tasks got no document
    want = {(r["item_id"], r["doc_id"]): r["score"] for r in text.keyword_scores(d, q, "doc_id", "item_id").collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-6)


def test_equal_terms_are_added_up_some_at_a_time():
    parts = [[5, 5, -1], [5, 2], [], [2, 2, 9, -1], [9]]
    out = list(search._added_up(4)(pa.record_batch([pa.array(p, pa.int64())], ["term"]) for p in parts))
    assert [o.to_pydict() for o in out] == [{"term": [-1, 2, 5], "n": [1, 1, 3]}, {"term": [-1, 2, 9], "n": [1, 2, 1]}, {"term": [9], "n": [1]}]
    total = Counter()
    for o in out:
        total.update(dict(zip(o["term"].to_pylist(), o["n"].to_pylist())))
    assert total == Counter(sum(parts, [])) and list(search._added_up(4)(iter([]))) == []


def test_postings_are_stored_by_passage(spark, tmp_path):
    store = search.PostingsStore(spark, str(tmp_path / "index"))
    p = spark.createDataFrame([("a", "x y x y z"), ("a", "x y x y z"), ("b", ""), ("c", None), (None, "x")], "key string, text string")
    store.refresh(p, 1)
    assert spark.read.parquet(str(tmp_path / "index/postings/version=1")).count() == 1  # a row per passage, not per term
    want = [("a", "x", 2), ("a", "x y", 2), ("a", "y", 2), ("a", "y x", 1), ("a", "y z", 1), ("a", "z", 1)]
    assert sorted(map(tuple, store.postings().collect())) == want
    assert sorted(r["key"] for r in store.alive().collect()) == ["a", "b", "c"]
    store.refresh(p.where("key = 'b'"), 2)
    assert store.postings().count() == 0 and [tuple(r) for r in store.alive().collect()] == [("b", 1)]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    shuffled = lambda: set(re.findall(r"shuffle_\d+", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))
    before = shuffled()
    with pytest.raises(ZeroDivisionError), sparing(spark):
        spark.range(50_000).repartition(7, "id").groupBy("id").count().write.parquet(str(tmp_path / "t"))
        for _ in range(100):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        assert shuffled() <= before and spark.read.parquet(str(tmp_path / "t")).count() == 50_000
        1 / 0
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_refreshing_leaves_only_the_index(spark, monkeypatch, tmp_path):
    """What a version compares is dropped when it is there, terms share what they have in common, and who counts terms doesn't read them."""
    tables, store = [], search.write_shared

    def stored(df, name):
        tables.append(store(df, name))
        return tables[-1]
    monkeypatch.setattr(search, "write_shared", stored)
    index = search.PostingsStore(spark, str(tmp_path / "index"))
    p = spark.createDataFrame([("a", "x y x y z"), ("b", ""), ("c", "z")], "key string, text string")
    files = []
    monkeypatch.setattr(search, "drop_shared", lambda df, drop=search.drop_shared: (files.extend(df.inputFiles()), drop(df)))
    index.refresh(p, 1)
    index.refresh(p.where("key <> 'c'"), 2)
    assert len(tables) == 2 and files and not any(Path(f.removeprefix("file:")).exists() for f in files)
    counts = index.postings().groupBy("key").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "counts:array" in plan and "terms:array" not in plan
    assert [tuple(r) for r in counts.collect()] == [("a", 6, 9)]
    assert {(r["term"], r["n"]) for r in index.postings().collect()} == {("x", 2), ("x y", 2), ("y", 2), ("y x", 1), ("y z", 1), ("z", 1)}
    assert all(".zstd." in f for f in spark.read.parquet(str(tmp_path / "index/postings/version=1")).inputFiles())


def test_whole_numbers_are_packed_and_come_back():
    for columns in ([[], []], [[0], [2 ** 64 - 1]], [[5, 1, 2 ** 40, 2 ** 63], [1, 1, 1, 300]]):
        arrays = [np.array(c, "<u8") for c in columns]
        assert search._unpacked(search._packed(*arrays), 2, len(arrays[0])).tolist() == columns
    many = np.sort(np.random.default_rng(3).integers(0, 2 ** 63, 20_000).astype("<u8"))
    assert len(search._packed(np.diff(many, prepend=np.uint64(0)), np.ones_like(many))) < 8 * len(many)


def test_terms_not_asked_for_are_not_stored(spark, monkeypatch, tmp_path):
    """Of terms no query asks for neither a document's row nor the table of counts names any, and the counts go once they are used."""
    rnd = random.Random(8)
    some = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    rows = [(i, some(30)) for i in range(60)] + [(4, some(9)), (90, None), (91, ""), (None, "w1")]
    d, q = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, some(5)) for i in range(7)], "item_id bigint, text string")
    asked, kept, files, store = text.terms(q, "item_id").select("term").distinct().count(), {}, [], search.write_shared

    def stored(df, name):
        out = store(df, name)
        kept[name] = (out.columns, out.where("term IS NOT NULL").count() if "term" in out.columns else 0)
        files.extend(out.inputFiles() if name == "idf" else [])
        return out
    monkeypatch.setattr(search, "write_shared", stored)
    monkeypatch.setattr(search, "TASK_CHARS", 300)
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in search.best(search.Keywords(d, q, "doc_id", "item_id"), 100).collect()}
    want = {(r["item_id"], r["doc_id"]): r["score"] for r in text.keyword_scores(d.where("doc_id IS NOT NULL"), q, "doc_id", "item_id").collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-6)
    assert 0 < kept["idf"][1] < asked and kept["looked-up"][0] == ["doc_id", "norm", "terms", "counts"]
    assert files and not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_passages_for_search_take_little_disk(spark, monkeypatch):
    """hits_at_k stores its passages compressed by zstd, without shuffle files that outlive the query that made them, and leaves the settings as they were."""
    before, tables, store = [spark.conf.get(k, None) for k in SPARING], [], catalog.write_shared

    def stored(df, name):
        tables.append(store(df, name))
        return tables[-1]
    monkeypatch.setattr(catalog, "write_shared", stored)
    assert catalog.QUERIES["hits_at_k"](spark, SF).count() > 0
    assert len(tables) == 1 and all(".zstd." in f for f in tables[0].inputFiles())
    assert [spark.conf.get(k, None) for k in SPARING] == before
