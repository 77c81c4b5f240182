import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>, planes string, vector int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, label, whole vector)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in sorted(rows):
        if a not in anchors:
            continue
        scored = sorted((-dot(v, w), b, m) for b, m, w in rows if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(t, n) for t, n, m in scored if m != label and -low * s <= -100 * t <= -high * s]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit[:negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_scores_by_lookups_are_inner_products():
    rng = np.random.default_rng(1)
    for width, most in ((1, 1), (8, 2), (13, 200), (64, 1 << 20)):
        a, c = (rng.integers(-most, most, (n, width)) for n in (5, 33))
        bits = 1 + int(most).bit_length()
        assert (N.scores(N.subset_sums(a), N.bit_planes(c, bits), bits) == c @ a.T).all()


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_equal_to_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(N, "ANCHOR_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, [float(x) for x in rng.integers(-3, 4, 11) / 8.0]) for i in range(90)]
    df = spark.createDataFrame([(i, m, v, "x", 1) for i, m, v in rows], SCHEMA)
    got = found(N.hard_negatives(N.scaled_vectors(df), F.col("vec_id") % 5 == 0))
    want = brute([(i, m, [int(np.floor(256 * x)) for x in v]) for i, m, v in rows], set(range(0, 90, 5)))
    assert got == want and len(want) > 20


def test_ties_repeats_nulls_and_lengths(spark):
    one = [0.5, 0.5]
    rows = [(0, 1, one), (0, 1, one), (1, 1, one), (2, 2, [0.4, 0.4]), (3, 2, [0.4, 0.4]), (4, 2, [0.4]), (5, None, one), (6, 2, None), (None, 2, one),
            (7, 2, [0.4, None]), (8, 2, [0.4, float("nan")]), (9, 2, [0.4, float("inf")]), (11, 3, [0.4, 0.4, 0.0]), (12, 2, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = found(N.hard_negatives(N.scaled_vectors(df), F.col("vec_id") == 0))
    score, near = 2 * 128 * 128, 2 * 128 * 102
    assert got == [(0, 1, 1, 2, score, near), (0, 1, 2, 3, score, near), (0, 1, 3, 11, score, near)]


def test_few_or_no_partners(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(N.hard_negatives(N.scaled_vectors(empty), F.col("vec_id") == 0)) == []
    alone = spark.createDataFrame([(0, 1, [1.0], "x", 1), (1, 2, [1.0], "x", 1)], SCHEMA)
    assert found(N.hard_negatives(N.scaled_vectors(alone), F.col("vec_id") == 0)) == []
    blank = spark.createDataFrame([(i, i % 2, [], "x", 1) for i in range(4)], SCHEMA)
    assert found(N.hard_negatives(N.scaled_vectors(blank), F.col("vec_id") == 0)) == [(0, 2, 1, 1, 0, 0), (0, 2, 2, 3, 0, 0)]


def test_an_id_with_several_vectors_is_an_anchor_once(spark):
    rows = [(0, 1, [1.0]), (0, 1, [2.0]), (1, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.75]), (3, 2, [0.4])]
    got = found(N.hard_negatives(N.scaled_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)), F.col("vec_id") == 0))
    full, half = 256 * 256, 256 * 128
    assert got == [(0, 1, 1, 2, full, 256 * 192), (0, 1, 1, 3, half, 256 * 102)]


def test_components_beyond_64_bit_sums_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e9], "x", 1), (1, 1, [1.0], "x", 1)], SCHEMA)
    with pytest.raises(ValueError, match="scale"):
        N.hard_negatives(N.scaled_vectors(df), F.col("vec_id") == 0)
