import re
from collections import Counter

import numpy as np
import pytest
from oracle_check import compare, connect

from tillwatch.llm import phrases as P
from tillwatch.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, stratum int, chunk string"


def brute(docs, least, longest, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of documents (text, lang)."""
    out = []
    for lang in {m or "und" for _, m in docs}:
        f, n = Counter(), 0
        for text, m in docs:
            if (m or "und") != lang:
                continue
            lower = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                ws = re.findall(r"[^\x20\x09]+", piece)
                n += len(ws)
                f.update(" ".join(ws[i:i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
        found = {p: c for p, c in f.items() if c >= least}
        kept = []
        for p, a in found.items():
            ws = p.split(" ")
            longer = [q for q, c in found.items() if c >= a and len(q) > len(p) and f" {p} " in f" {q} "]
            if len(ws) == 1 or longer:
                continue
            parts = [(" ".join(ws[:k]), " ".join(ws[k:])) for k in range(1, len(ws))]
            score, _, left, right = min((1000 * a * n // (f[x] * f[y]), k, f[x], f[y]) for k, (x, y) in enumerate(parts))
            kept.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def mined(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, m, 1, "x") for i, (t, m) in enumerate(docs)], SCHEMA)
    return sorted(tuple(r) for r in P.collocations(df, **kw).collect())


@pytest.mark.parametrize("chunk, dense, sent", [(8 << 20, 1 << 15, 400_000), (300, 8, 0)])
def test_equal_to_brute_force(spark, monkeypatch, chunk, dense, sent):
    for name, value in (("CHUNK_BYTES", chunk), ("DENSE", dense), ("MAX_SENT", sent)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(3)
    words = ["a", "B", "ç", "dd", "New", "york", "x1", "the"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " "]
    docs = [("".join(words[min(int(rng.exponential(2)), 7)] + ends[rng.integers(0, 7)] for _ in range(40)), ["en", "fr", None][i % 3]) for i in range(60)]
    want = brute(docs, 8, 5)
    assert mined(spark, docs, least=8) == want and len(want) > 50
    assert mined(spark, docs, least=8, longest=3, top=7) == brute(docs, 8, 3, 7)


def test_odd_texts(spark):
    docs = [(None, None), ("", "en"), (" \t\n.,", "en"), ("one", "en"), ("go go go go", "de"), ("go go go go", "de"), ("go go go go", "de"), (".a b.a b!a b", "xx"),
            ("a\x0bb\x0cc\x0dd a b\n", "xx"), ("w1 w2 " * 40000, "long")]
    want = brute(docs, 3, 5)
    assert mined(spark, docs, least=3) == want and {x[0] for x in want} == {"de", "xx", "long"}


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [("a b c", "en")] * 9) == []


def test_codes_are_packed_without_loss():
    for most in (3, 65534, 65535, 1 << 20):
        codes = np.array([-1, 0, most, -1, most - 1], np.int32)
        assert (P._unpacked(memoryview(P._packed(codes))) == codes).all()
    assert len(P._unpacked(memoryview(P._packed(np.zeros(0, np.int32))))) == 0


def test_pairs_by_tiles_equal_a_counter(monkeypatch):
    monkeypatch.setattr(P, "TILE", 4)
    monkeypatch.setattr(P, "DENSE", 30)
    rng = np.random.default_rng(5)
    codes = np.minimum(rng.exponential(4, 3000).astype(np.int32), 40) - 1
    want = Counter((int(a), int(b)) for a, b in zip(codes, codes[1:]) if a >= 0 and b >= 0)
    a, b, n = P.count_pairs(codes)
    assert {(int(x), int(y)): int(k) for x, y, k in zip(a, b, n)} == want and len(a) == len(want)



def test_decimal_division_is_exact(spark):
    rows = [(10**12 + 7, 10**14 + 9, 10**12 + 11, 3 * 10**12 + 1), (100, 10**15, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    exact = lambda *c: " * ".join(f"cast({x} as decimal(38,0))" for x in c)
    got = [r[0] for r in df.selectExpr(f"({exact('1000', 'a', 'n')}) div ({exact('l', 'r')})").collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_equal_to_sql_on_more_data(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op13_collocations"](spark, folder)
    message, rows = compare(out, connect(folder), SQL["op13_collocations"])
    assert message == "" and rows > 50
