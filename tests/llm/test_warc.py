import gzip
import hashlib
import random
import zlib

import pytest

from tillwatch.llm import warc


def expected(rows):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    out = []
    for i, _, h in rows:
        to = first.get(digest(h), i)
        out.append((i, len((h or "").encode()), digest(h), "response" if to == i else "revisit", to if to != i else None))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    rnd = random.Random(2)
    texts = ["x" * 100, "y" * 99, "", None, "é\r\n\r\n" * 40, "WARC/1.1\r\n\r\n" * 20, "".join(chr(rnd.randint(1, 0x2FFF)) for _ in range(5000))]
    rows = [(i, f"http://a/{i}\r\nX: 1 é" if i % 5 else None, rnd.choice(texts)) for i in range(80)] + [(None, "u", "z" * 10), (3, "again", "w" * 200)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    got = warc.round_trip(table).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows)
    bodies = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(bodies[i] == (h or "") for i, _, h in rows if i in bodies and i != 3)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_members_can_be_read_alone_and_damage_is_noticed(spark):
    table = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(9)], "page_id long, url string, html string").coalesce(1)
    path = warc.normalise(warc.write_archives(table)).first().path
    import json
    fs, place = warc._fs(path)
    index = [json.loads(x) for x in fs.open_input_stream(place + ".index", compression=None).read().decode().splitlines()]
    with fs.open_input_file(place) as f:
        whole = f.read()
    last = index[-1]
    member = whole[last["offset"]:last["offset"] + last["length"]]
    assert warc.parse_member(member)["payload"] == f"page {warc.parse_member(member)['page_id']} " * 50
    assert gzip.decompress(whole).count(b"WARC-Type") == 9
    bad = zlib.compress(zlib.decompress(member, 31).replace(b"page", b"gape"), wbits=31)
    with pytest.raises(ValueError):
        warc.parse_member(bad)


def test_stream_reads_one_and_many_members():
    import io
    raw = b"A\r\n\r\n12345" * 3
    for packed in (gzip.compress(raw), b"".join(gzip.compress(raw[i:i + 7]) for i in range(0, len(raw), 7))):
        s = warc._Stream(io.BytesIO(packed))
        seen = 0
        while s.head() is not None:
            assert s.take(5) == b"12345"
            seen += 1
        assert seen == 3
    with pytest.raises(ValueError):
        s = warc._Stream(io.BytesIO(gzip.compress(b"A\r\n\r\n12")))
        s.head()
        s.take(5)
