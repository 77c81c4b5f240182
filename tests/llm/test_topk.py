import numpy as np
from pyspark.sql import functions as F

from tillwatch.llm import topk


def brute(rows, k):
    vectors = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            vectors[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    out = []
    for q in sorted(i for i in vectors if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def found(spark, rows, k):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("x")).withColumn("block", F.lit(1)).repartition(3)
    vectors = topk.whole_vectors(table)
    return sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, k).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 20)]) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, [0.0] * 20), (301, None), (302, [None] + [0.1] * 19), (303, [float("nan")] * 20),
                                                         (304, [float("inf")] * 20), (305, []), (None, [1.0] * 20), (310, [0.5] * 3)]
    assert found(spark, rows, 10) == brute(rows, 10)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    assert found(spark, rows, 10) == brute(rows, 10)
    large = [(i, [float(2.0**40 * x) for x in range(i % 3)]) for i in range(12)]
    assert found(spark, rows[:12] + [(0 if i == 0 else 400 + i, v) for i, (_, v) in enumerate(rows[12:20])], 500)
    assert len(found(spark, large, 20)) == 22


def test_empty_table(spark):
    assert found(spark, [(1, [1.0])], 3) == []
    assert topk.top_k(topk.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")), F.col("vec_id") == 1).count() == 0


def test_block_search_is_exact_on_integers():
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (300, 24))
    q_ids, _, scores = topk.search_block(np.arange(300), v, np.arange(300), np.ascontiguousarray(v.T), 7)
    full = v @ v.T
    np.fill_diagonal(full, -10**6)
    want = np.sort(full, axis=1)[:, ::-1][:, :7]
    assert (scores.reshape(300, 7) == want).all() and (q_ids.reshape(300, 7) == np.arange(300)[:, None]).all()
