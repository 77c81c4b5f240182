import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tillwatch.llm import lm

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def base(rows):
    out_of = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = collections.Counter()
    for i, t in rows:
        if not out_of[i]:
            c.update(words(t) + ["END"])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        tokens = words(t) + ["END"]
        out[i] = (out_of[i], len(tokens), sum(x in c for x in tokens), n, sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in tokens))
    return out


def test_base_is_exact_and_the_model_beats_it(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        w, state = [], rnd.randrange(20)
        for _ in range(rnd.randint(0, 60)):
            state = (state * 3 + rnd.choice([1, 2])) % 20
            w.append(f"W{state}" if rnd.random() < .9 else f"rare{rnd.randrange(3000)}")
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "NEVER seen words"), (1003, "w1 " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    want = base(rows)
    for head in (lm.HEAD, 30):
        got = {r.doc_id: r for r in lm.score_texts(docs, held(), head=head).collect()}
        assert len(got) == len(rows)
        for i, w in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        unseen = [r for r in got.values() if r.held_out and r.n_tokens > 5 and r.doc_id < 1000]
        assert sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)
        assert all(r.score <= 0 for r in got.values())


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(1)
    table = lm.fit(rng.integers(0, lm.CLASSES * 5, 500), rng.integers(1, 9, 500), steps=20)
    assert np.allclose((10**table).sum(axis=1), 1)
    docs = spark.createDataFrame([("a b c d a b",), ("b c zz yy",), (None,)], "text string")
    corpus = lm.Corpus(lm.word_counts(docs), head=4, top=3)
    assert corpus.tokens == 13 and corpus.distinct == 7
    assert abs(corpus.share.sum() - (sum(corpus.n[~corpus.is_top]) + 0.5 * (sum(~corpus.is_top) + lm.SUFFIXES)) -
               1.5 * (corpus.distinct - len(corpus.words))) < 1e-9 or len(corpus.words) < corpus.distinct


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert lm.score_texts(docs.where("false"), held()).count() == 0
    got = lm.score_texts(docs, F.lit(False)).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {8} and all(r.n_known == r.n_tokens for r in got)
    unknown = lm.score_texts(docs, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in unknown} == {(0, 0)}
