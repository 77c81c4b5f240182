import random

import numpy as np
import pandas as pd

from tillwatch.llm import setsketch


def brute_force(rows: list[tuple[int, str | None]], shingle: int = 5, percent: int = 80) -> pd.DataFrame:
    """The same rule on a few rows by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    low = [i for i, _ in rows]
    changed = True
    linked = [(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y]
              and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])]
    while changed:
        changed = False
        for x, y in linked:
            if low[x] != low[y]:
                low[x] = low[y] = min(low[x], low[y])
                changed = True
    return pd.DataFrame({"doc_id": [i for i, _ in rows], "n_shingles": [len(s) for s in sets], "component_id": low,
                         "kept": [i == c for (i, _), c in zip(rows, low)]})


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopÉQ"]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 6, 40, 90]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 3 % 101, " ".join(w).upper() if rnd.random() < .2 else " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "Word"), (504, "word"), (505, "word word"), (506, "a " * 50)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    for shingle in (2, 5):
        got = setsketch.near_duplicates(table, shingle).select("doc_id", "n_shingles", "component_id", "kept").toPandas()
        want = brute_force(rows, shingle).sort_values("doc_id")
        assert got.sort_values("doc_id").values.tolist() == want.values.tolist()
        assert setsketch.without_near_duplicates(table, shingle).count() == want.kept.sum()


def test_empty_and_repeated_rows(spark):
    table = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "x y")], "doc_id long, text string")
    assert setsketch.near_duplicates(table.where("false")).count() == 0
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in setsketch.near_duplicates(table).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True)]
    assert setsketch.without_near_duplicates(table).count() == 2


def test_registers_are_mergeable_and_estimate_similarity():
    rnd = np.random.default_rng(1)
    x = np.unique(rnd.integers(0, 2**52, 3000).astype(np.uint64))
    y = np.concatenate((x[:2400], np.unique(rnd.integers(0, 2**52, 600).astype(np.uint64))))
    both = np.unique(np.concatenate((x, y)))
    k = [setsketch.registers(s, np.array([0, len(s)]), 2048) for s in (x, y, both)]
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    true = 2400 / len(both)
    got = setsketch.joint_estimate(k[0], k[1], np.array([float(len(x))]), np.array([float(len(y))]))[0]
    assert abs(got - true) < 0.04


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    for name, value in (("LARGE", 3), ("HOST_BLOCK", 4), ("ASK_BLOCK", 5)):
        monkeypatch.setattr(setsketch, name, value)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.choice([0, 2, 4, 5, 6, 7, 8, 9])):
            w[rnd.randrange(80)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = setsketch.near_duplicates(table, 2).select("doc_id", "n_shingles", "component_id", "kept").toPandas().sort_values("doc_id")
    want = brute_force(rows, 2).sort_values("doc_id")
    assert got.values.tolist() == want.values.tolist() and 1 < want.component_id.nunique() < 60


def test_rows_without_id_whose_texts_share_a_32_bit_hash(spark):
    """Two unrelated texts with the same Spark hash are two documents; blank texts are told apart too."""
    one, two = (" ".join(f"w{i}x{j}" for j in range(40)) for i in (23147, 205656))
    table = spark.createDataFrame([(None, one), (None, two), (None, ""), (None, " ")], "doc_id long, text string")
    assert table.where("length(text) > 9").selectExpr("hash(text) as h").distinct().count() == 1
    assert {r.text for r in setsketch.without_near_duplicates(table).collect()} == {one, two, "", " "}


def test_a_crowd_alike_below_the_threshold_is_compared_in_blocks(spark, monkeypatch):
    """Form letters alike at about 0.7: no links but the two planted ones, and no table of their pairs."""
    rnd = random.Random(4)
    form = [f"f{i}" for i in range(60)]
    texts = [" ".join(form + [f"x{i}y{j}" for j in range(12)]) for i in range(600)]
    texts += [texts[17] + " more", texts[400] + " words here"]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    made = []
    links = setsketch._links
    monkeypatch.setattr(setsketch, "_links", lambda pairs, *a: (made.append(pairs.count()), links(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    assert {i for i, c in got.items() if i != c} == {600, 601} and got[600] == 17 and got[601] == 400
    assert sum(made) < 600 * 45 + setsketch.SMALL * 600 * 4


def test_further_columns_come_back(spark):
    rows = [(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 8, 9, 10)]
    got = setsketch.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key_high int, key_low int, row_rank int")).collect()
    assert [tuple(r) for r in got] == [rows[0]]
