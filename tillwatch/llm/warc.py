"""WARC archives: whole-file gzip streams, their normaliser with a sidecar offset index, and a reader by index.

Archives arrive as one gzip stream around all records, which can only be read from the start. The normaliser inflates such a stream
once, a chunk at a time, writes every record as a gzip member of its own and notes offset and length of each in a sidecar file, so any record
can be read alone. Tasks write below a folder all executors share; a file counts only if the stored manifest of its job names
it, so what a lost task left behind is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.tables import store
from tillwatch.session import shared_dir

LEAST_BYTES = 100
FILE_BYTES = 256 << 20
CHUNK = 1 << 18
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "path string, records long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: rows whose payload of at least ``least_bytes`` bytes occurs with a smaller page_id refer to
    the smallest; refers_to is null for responses. Rows that repeat the smallest page_id are responses too."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response or revisit record."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str):
    def run(frames):
        out = deflate = path = None
        count = size = 0
        files, base = _fs(folder)
        for frame in frames:
            for page_id, url, html, digest, refers_to in frame.itertuples(index=False, name=None):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out, deflate = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                as_int = lambda x: None if pd.isna(x) else int(x)
                raw = record(as_int(page_id), url, html.encode(), digest, as_int(refers_to), date)
                out.write(deflate.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= FILE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [count]})
                    out, count, size = None, 0, 0
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "records": [count]})
    return run


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """path, records of whole-file gzip archives with a record for every row of ``pages`` (page_id, url, html)."""
    folder = shared_dir(pages.sparkSession, "warc")
    _make(pages.sparkSession, folder)
    return store(plan_records(pages, least_bytes).mapInPandas(_writer(folder, date), _FILES), "archives")


def _make(spark, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


class _Stream:
    """Bytes of a gzip file, one or many members, inflated a chunk at a time."""

    def __init__(self, source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        raw = self.inflate.unused_data or self.source.read(CHUNK)
        if self.inflate.eof:
            if not raw:
                return False
            self.inflate = zlib.decompressobj(31)
        elif not raw:
            if self.held or self.inflate.unconsumed_tail:
                raise ValueError("archive ends within a record")
            return False
        self.held += self.inflate.decompress(raw)
        return True

    def head(self) -> bytes | None:
        """Header lines up to the empty line; None at the end."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("archive ends within a header")
                return None
        out = bytes(self.held[:at + 4])
        del self.held[:at + 4]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}


def _normaliser(folder: str):
    def run(frames):
        files, base = _fs(folder)
        for frame in frames:
            for path in frame["path"]:
                source_fs, place = _fs(path)
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset, index = 0, []
                with source_fs.open_input_stream(place, compression=None) as source, files.open_output_stream(f"{base}/{name}", compression=None) as out:
                    stream = _Stream(source)
                    while (head := stream.head()) is not None:
                        about = fields(head)
                        rest = stream.take(int(about["content-length"]) + 4)
                        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = deflate.compress(head) + deflate.compress(rest) + deflate.flush()
                        out.write(member)
                        index.append({"offset": offset, "length": len(member), "id": about["warc-record-id"].strip("<>"), "type": about["warc-type"]})
                        offset += len(member)
                with files.open_output_stream(f"{base}/{name}.index", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(index)]})
    return run


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, min(files.count(), 10_000)))


def normalise(archives: DataFrame) -> DataFrame:
    """path, records of archives with one gzip member per record; beside each lies ``path``.index, a JSON line per record with
    offset, length, id and type."""
    folder = shared_dir(archives.sparkSession, "warc-members")
    _make(archives.sparkSession, folder)
    return store(_spread(archives).mapInPandas(_normaliser(folder), _FILES), "members")


def parse_member(raw: bytes) -> dict:
    """Fields of one record's gzip member; the payload of a response is checked against its digest."""
    import hashlib
    text = zlib.decompress(raw, 31)
    head, _, block = text.partition(b"\r\n\r\n")
    about = fields(head)
    block = block[:int(about["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: int(v[10:-1]) if v and v.startswith("<urn:page:") else None
    digest = about["warc-payload-digest"].removeprefix("sha256:")
    response = about["warc-type"] == "response"
    if response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {about['warc-record-id']} is damaged")
    size = len(payload) if response else int(fields(http)["content-length"])
    return {"page_id": page(about["warc-record-id"]), "url": about.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
            "record_type": about["warc-type"], "refers_to": page(about.get("warc-refers-to")), "payload": payload.decode() if response else None}


def _reader(frames):
    for frame in frames:
        for path in frame["path"]:
            files, place = _fs(path)
            with files.open_input_stream(f"{place}.index", compression=None) as f:
                index = [json.loads(x) for x in f.read().decode().splitlines()]
            with files.open_input_file(place) as f:
                for begin in range(0, len(index), 500):
                    rows = []
                    for x in index[begin:begin + 500]:
                        f.seek(x["offset"])
                        rows.append(parse_member(f.read(x["length"])))
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(members: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every indexed record."""
    return _spread(members).mapInPandas(_reader, _READ)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write all rows of ``pages``, normalise the archives and read every record back.

    Null html is an empty payload; null or odd urls and missing ids are allowed; repeated rows give repeated records; an empty table gives
    no archive and no row. Other columns of ``pages`` are not read.
    """
    return read_archives(normalise(write_archives(pages, least_bytes)))
