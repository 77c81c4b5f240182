import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tillwatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows, capacity=2048):
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rest int").repartition(3)
    got = packing.pack(table, PATH, capacity).toPandas()
    t = Tokenizer.from_file(PATH)
    for i, text in dict(rows).items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id == i].drop_duplicates("start").sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0] + s.length.cumsum().tolist()[:-1] and s.length.sum() <= capacity
    assert len(got) == sum(-(-len(t.encode(x or "", add_special_tokens=False).ids + [1]) // capacity) for _, x in rows)
    used = got.groupby("sequence_id").length.sum()
    waste = sum(0 if n & (n - 1) == 0 else capacity - n for n in used)
    return waste / max(1, used.sum())


def test_pieces_cover_every_document(spark):
    rnd = random.Random(4)
    vocabulary = ["Hello", "it's", "naïve", "中文", "12345", "x-y", "tokenisation", "<|endoftext|>", "é", " ", "a b", "end.", "ÉTÉ,", "e\u0301t", "İx", "'s", "it's.", "...", "ǅ", "ﬁn", "don't!?", "x<|y"]
    rows = [(i, "\n".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 40, 300])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 5000), (503, "same"), (504, "same"), (505, "x<|startoftext|>y z"), (7, rows[7][1])]
    check(spark, rows)
    check(spark, rows, 64)


def test_given_documents_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check(spark, [(r.doc_id, r.text) for r in docs.collect()]) < 0.03


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(2)
    for histogram in (rng.integers(0, 400, 2048), np.eye(2048, dtype=int)[7] * 1000, np.zeros(2048, int)):
        made = np.zeros(2048, int)
        for row, times in packing.plan(histogram):
            assert sum(row) <= 2048
            for v in row:
                made[v] += times
        histogram[0] = 0
        assert (made == histogram).all()
    rows = packing.plan(rng.integers(200, 400, 2048))
    pad = sum((2048 - sum(r)) * t for r, t in rows if sum(r) & (sum(r) - 1))
    assert pad < 0.005 * sum(sum(r) * t for r, t in rows)


def by_combination(rows, capacity=2048):
    """Share of the remainders that lie in exactly filled sequences, and the padding."""
    total = sum(len(r) * t for r, t in rows)
    full = sum(len(r) * t for r, t in rows if sum(r) == capacity or sum(r) & (sum(r) - 1) == 0)
    pad = sum((capacity - sum(r)) * t for r, t in rows if sum(r) & (sum(r) - 1))
    return full / total, pad / sum(sum(r) * t for r, t in rows)


def test_least_squares_place_most_remainders():
    rng = np.random.default_rng(1)
    for n in (10_000, 1_000_000):
        histogram = np.bincount(rng.lognormal(6.0, 0.8, n).astype(int) % 2048, minlength=2048)
        histogram[0] = 0
        share, padding = by_combination(packing.plan(histogram))
        assert share > 0.85 and padding < 0.001


def test_counts_solve_the_least_squares():
    """A histogram made of combinations is met; no column has a price worth taking in the end."""
    rng = np.random.default_rng(3)
    histogram = np.zeros(65, np.int64)
    for _ in range(40):
        a, b = sorted(rng.integers(1, 32, 2))
        histogram[[a, b, 64 - a - b]] += rng.integers(1, 50)
    rows, counts = packing.solve_counts(histogram, 64)
    assert all(sum(r) == 64 or r in {(1,), (2,), (4,), (8,), (16,), (32,)} for r in rows) and min(counts) >= 0
    made = np.zeros(65)
    for row, n in zip(rows, counts):
        for v in row:
            made[v] += n
    assert np.abs(histogram - made).sum() < 0.05 * histogram.sum()
