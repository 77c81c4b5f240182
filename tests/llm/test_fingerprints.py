import hashlib
import random

from pyspark.sql import functions as F

from tillwatch.llm import fingerprints


def pick(hashes, window=4):
    """Places that winnowing keeps."""
    out = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i:i + window]
        at = max(k for k, h in enumerate(part) if h == min(part)) + i
        if not out or out[-1] != at:
            out.append(at)
    return out


def test_winnowing_against_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, "", " \t ", "  a  b\n", "same " * 30]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprints.winnow(table, F.col("text"), "fp").collect()
    size = lambda t: len((t or "").split())
    grams = {}
    for r in rows:
        words = (r.text or "").split()
        for p in r.fp:
            grams.setdefault(tuple(words[p.place:p.place + 5]), set()).add(p.hash)
    assert all(len(h) == 1 for h in grams.values())
    wide = fingerprints.winnow(table, F.col("text"), "fp", window=1).collect()
    every = {r.doc_id: [p.hash for p in r.fp] for r in wide}
    for r in rows:
        n = size(r.text)
        assert len(every[r.doc_id]) == (n - 4 if n >= 5 else min(n, 1)) or len(set(every[r.doc_id])) < n
    for r in rows:
        words = (r.text or "").split()
        known = {g: next(iter(h)) for g, h in grams.items()}
        full = [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4) if words else 0)]
        if all(g in known for g in full):
            assert [p.place for p in r.fp] == pick([known[g] for g in full])


def test_edited_texts_and_next_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    rnd = random.Random(1)
    rows = [(i * 7 % 41, " ".join(rnd.choice(["día", "noche", "sol", "mar"]) for _ in range(rnd.randint(0, 30)))) for i in range(41)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "word " * 500)]
    table = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, hashes string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.edited_likeness(table).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_text == t[:len(t) - half] + nxt[:half]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    again = fingerprints.edited_likeness(table.select("doc_id", F.lit("one and the same text of some length").alias("text")))
    assert all(r.near_next == 1.0 for r in again.collect())
    digests = {r.d for r in again.select(fingerprints.digest("fingerprint").alias("d")).collect()}
    assert len(digests) == 1 and len(hashlib.sha256().hexdigest()) == len(digests.pop())


def test_empty_single_and_repeated(spark):
    table = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "z")], "doc_id long, text string")
    assert fingerprints.edited_likeness(table.where("false")).count() == 0
    assert fingerprints.edited_likeness(table).count() == 3
    one = fingerprints.edited_likeness(table.where("text = 'z'")).first()
    assert (one.doc_id, one.edited_text, one.near_next) == (None, "z", 1.0)
