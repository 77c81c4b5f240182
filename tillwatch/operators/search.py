"""Keyword and vector search over blocks of documents, and the fusion of both ranks.

Documents are dealt into blocks by their key and queries into blocks of their own; a task scores one block of each and hands on a few rows per query, so
no pair of a query and a document ever becomes a row.

* **Keywords.** A block gets its documents' query terms and makes one list per term: documents with their weights, the greatest first, so the first weight bounds the list. Lists
  are added in the order of their bounds. Once what the remaining lists can add is below the k-th best score so far, no new document is
  taken up, and documents that can no longer reach it are dropped (max-score).
* **Vectors.** One matrix product per pair of blocks.
* **Fusion.** Only the heads of the two lists can win. Their ranks in the other list are counted block by block, exactly.

Scores are rounded to six digits, greater scores first, ties by the document's key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions.prefix import numbered
from tillwatch.functions.tables import union_on
from tillwatch.operators.text import RRF, TOP_K, counted_terms, term_hashes, terms, top_k, word_lists
from tillwatch.session import drop_shared, sparing, write_shared

#: Documents of a block, their query terms, queries with vectors, and queries with words.
DOC_BLOCK, TERM_BLOCK, QUERY_BLOCK, WORD_QUERY_BLOCK = 8192, 1 << 21, 256, 4096
#: Not used any more, as no term is sent to every task; tests still set it.
SENT_TERMS = 1 << 20
#: Characters of text for each chunk of documents and each range of hashes, and terms a task holds to add up equal ones.
TASK_CHARS, HELD_TERMS = 1 << 22, 1 << 21
#: Scores this close may change places by rounding.
_SLACK = 1.1e-6

#: A query, its documents in ascending order, and their scores.
Found = tuple[object, np.ndarray, np.ndarray]


# ---------------------------------------------------------------- tables

def _with_counts(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often each occurs."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])[:len(numbers)])
    return numbers[first], np.diff(np.append(first, len(numbers)))


def _added_up(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, n) from a column of terms: equal terms of a task are added up, about ``most`` at a time, so that it never holds more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b.column(0).to_numpy())
                size += b.num_rows
            if size and (b is None or size >= most):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _with_counts(np.concatenate(held))], ["term", "n"])
                held, size = [], 0
    return run


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, their bytes by place, compressed: small or sorted and subtracted numbers take few bytes."""
    planes = np.stack([c.astype("<u8") for c in columns]).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, columns: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, columns * size * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 8, size).transpose(0, 2, 1)).view("<u8").reshape(columns, size)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists of 64-bit hashes, as unsigned numbers."""
    return [x for c in column.chunks for x in map(c.values.to_numpy().view("<u8").__getitem__, map(slice, c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:]))]


def _counted(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some documents in order, and in how many of them each occurs."""
    some = ([_with_counts(d)[0] for d in documents[i:i + 256]] for i in range(0, len(documents), 256))
    batches = (pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view("<i8"))], ["term"]) for x in some)
    found = [[c.to_numpy() for c in b.columns] for b in _added_up(HELD_TERMS)(batches)]
    if not found:
        return np.zeros(0, "<u8"), np.zeros(0, "<u8")
    names, n = np.concatenate([t for t, _ in found]).view("<u8"), np.concatenate([n for _, n in found])
    order = np.argsort(names, kind="stable")  # signed runs in order: little is left to do
    names, n = names[order], n[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(n, first).astype("<u8")


def weighted_terms(docs: DataFrame, key: str, asked: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, norm, terms, counts), (term, number, idf)): of each document the length of its tf-idf vector (tf = 1 + ln n, idf = ln((1 + N) / (1 + df)) + 1)
    and its terms among ``asked`` (term), by number; of these their idf. Stored.

    Terms are compared by 64-bit hashes and never leave their document one by one. Documents are dealt into chunks, by their key, and hashes into ranges, as many
    of each as the length of all texts asks for. A chunk sends each range its terms there, in order and packed, with their documents; the range adds up the chunks and answers
    each with the terms' df and numbers, in the order they came, so that an answer names no term. Texts are shuffled whole, once to ask and once to use the answers.
    """
    n_docs, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    tasks = max(-(-chars // TASK_CHARS), docs.sparkSession.sparkContext.defaultParallelism)
    kind = docs.schema[key].dataType.simpleString()
    chunk = F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")
    words = word_lists(docs.select(chunk.alias("__chunk"), key, text).repartitionById(tasks, F.col("__chunk")), "__chunk", key, text=text)
    words = words.select("__chunk", key, term_hashes("words").alias("hashes"))

    def ask(table: pa.Table) -> pa.Table:
        names, n = _counted(_lists(table["hashes"]))
        cuts = np.searchsorted((names >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32), np.arange(tasks + 1, dtype="<u8"))
        parts = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
        data = [_packed(np.diff(names[a:b], prepend=np.uint64(0)), n[a:b]) for _, a, b in parts]
        return pa.table({"range": pa.array([r for r, _, _ in parts], pa.int32()), "chunk": pa.array([table["__chunk"][0].as_py()] * len(parts), pa.int32()),
                         "size": pa.array([b - a for _, a, b in parts], pa.int32()), "data": pa.array(data, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        wanted = table.filter(table["chunk"].is_null())
        order = np.argsort(names := wanted["term"].to_numpy().view("<u8"))
        names, numbers = names[order], wanted["number"].to_numpy()[order]
        parts = table.filter(table["chunk"].is_valid())
        sizes = parts["size"].to_pylist()
        sent = [_unpacked(d, 2, n) for d, n in zip(parts["data"].to_pylist(), sizes)]
        terms, at = np.unique(np.concatenate([np.cumsum(x[0], dtype="<u8") for x in sent] or [np.zeros(0, "<u8")]), return_inverse=True)
        df = np.bincount(at, np.concatenate([x[1] for x in sent] or [np.zeros(0)]), len(terms)).astype("<i8")
        number = np.zeros(len(terms), "<i8")  # from 1; 0: not asked for
        place = np.searchsorted(terms, names)
        known = np.append(terms, np.uint64(0))[place] == names
        known &= place < len(terms)
        number[place[known]] = numbers[known] + 1
        ends = np.cumsum(sizes, dtype=int)
        data = [_packed(df[i], number[i]) for i in (at[e - n:e] for e, n in zip(ends, sizes))]
        n_parts, n_known = len(sizes), int(known.sum())
        none = lambda n, kind: pa.nulls(n, kind)
        both = lambda *parts: pa.chunked_array(list(parts))
        return pa.table({"range": both(parts["range"].combine_chunks(), none(n_known, pa.int32())), "chunk": both(parts["chunk"].combine_chunks(), none(n_known, pa.int32())),
                         "size": both(parts["size"].combine_chunks(), none(n_known, pa.int32())), "data": both(pa.array(data, pa.binary()), none(n_known, pa.binary())),
                         "term": both(none(n_parts, pa.int64()), pa.array(names[known].view("<i8"))), "number": both(none(n_parts, pa.int64()), pa.array(numbers[known])),
                         "df": both(none(n_parts, pa.int64()), pa.array(df[place[known]]))})
    sent = words.groupBy("__chunk").applyInArrow(ask, "range int, chunk int, size int, data binary")
    sent = sent.withColumns({"term": F.lit(None).cast("bigint"), "number": F.lit(None).cast("bigint")})
    none = F.lit(None)
    place = F.shiftright(F.shiftrightunsigned("term", 32) * F.lit(tasks).cast("bigint"), 32).cast("int")
    asked = numbered(asked, [F.col("term")], "number").select(place.alias("range"), none.cast("int").alias("chunk"), none.cast("int").alias("size"),
                                                              none.cast("binary").alias("data"), "term", "number")
    parts = sent.unionByName(asked).repartitionById(tasks, F.col("range")).groupBy("range")
    idf = write_shared(parts.applyInArrow(answer, "range int, chunk int, size int, data binary, term bigint, number bigint, df bigint"), "idf")

    def look_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        counted = [_with_counts(d) for d in _lists(table["hashes"])]
        names = _with_counts(np.concatenate([h for h, _ in counted] or [np.zeros(0, "<u8")]))[0]
        answers = answers.sort_by("range")
        got = [_unpacked(d, 2, n).astype("<i8") for d, n in zip(answers["data"].to_pylist(), answers["size"].to_pylist())]
        df, number = np.concatenate(got or [np.zeros((2, 0), "<i8")], axis=1)
        if len(df) != len(names):
            raise ValueError("the texts changed while they were read")
        at = np.concatenate([np.searchsorted(names, h) for h, _ in counted] or [np.zeros(0, int)])
        n, document = np.concatenate([n for _, n in counted] or [np.zeros(0, int)]), np.repeat(np.arange(len(counted)), [len(h) for h, _ in counted])
        weight = (1 + np.log(n)) * (np.log((1 + n_docs) / (1 + df)) + 1)[at]
        norm, wanted = np.sqrt(np.bincount(document, np.square(weight), len(counted))), number[at] > 0
        sizes = np.bincount(document[wanted], minlength=len(counted))
        there = np.flatnonzero(sizes)
        ends = pa.array(np.append(0, np.cumsum(sizes[there])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[wanted].astype(np.int64))) for x in (number[at] - 1, n)]
        return pa.table({key: table[key].take(pa.array(there)), "norm": pa.array(norm[there]), "terms": lists[0], "counts": lists[1]})
    answers = idf.where(F.col("chunk").isNotNull()).select("chunk", "range", "size", "data").repartitionById(tasks, F.col("chunk"))
    rows = words.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(look_up, f"`{key}` {kind}, norm double, terms array<bigint>, counts array<bigint>")
    rows = write_shared(rows, "looked-up")
    weights = idf.where(F.col("term").isNotNull()).select("term", "number", (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = write_shared(weights, "query-idf")
    drop_shared(idf)
    return rows, weights


class PostingsStore:
    """Postings of passages (key, text) that are refreshed version by version below ``root``.

    A version stores the postings of passages that are new, and for every key that came or went an event, written last. What counts is a key's
    newest event, so passages that went are dropped when reading (tombstones) and may come back. Only new passages are cut into terms. A version that died half
    way is refreshed again and replaces its own folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, version int")
        empty.drop("version").write.mode("overwrite").parquet(f"{self.root}/{name}/version=0")
        return self.spark.read.schema(empty.schema).parquet(f"{self.root}/{name}")

    def alive(self, before: int | None = None) -> DataFrame:
        """key, version: the passages that are there (before a version), and the version that brought them."""
        events = self._read("events", "key string, came boolean")
        events = events if before is None else events.where(F.col("version") < before)
        last = events.groupBy("key").agg(F.max(F.struct("version", "came")).alias("e"))
        return last.where("e.came").select("key", "e.version")

    def refresh(self, passages: DataFrame, version: int) -> None:
        """Make ``passages`` (key, text) the content of the store; versions count from 1.

        Passages meet the keys that are there in the shuffle that drops repeated ones; only texts of new keys go on.
        """
        with sparing(self.spark):
            self._refresh(passages, version)

    def _refresh(self, passages: DataFrame, version: int) -> None:
        here, there = F.lit(True).alias("here"), F.lit(True).alias("there")
        nothing = F.lit(None).cast("boolean")
        now = passages.where(F.col("key").isNotNull()).select("key", "text", here, nothing.alias("there"))
        stored = self.alive(version).select("key", F.lit(None).cast("string").alias("text"), nothing.alias("here"), there)
        keys = union_on([now, stored], "key").groupBy("key").agg(F.max("text").alias("text"), F.max("here").alias("here"), F.max("there").alias("there"))
        keys = write_shared(keys.where(F.col("here").isNull() | F.col("there").isNull()), "changes")
        # terms are in order: this version of the format stores of each what it doesn't share with the one before
        lists = counted_terms(keys.where("here"), "key").write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0")
        lists.parquet(f"{self.root}/postings/version={version}")
        events = keys.select("key", F.coalesce("here", F.lit(False)).alias("came"))
        events.write.mode("overwrite").parquet(f"{self.root}/events/version={version}")
        drop_shared(keys)

    def postings(self) -> DataFrame:
        """key, term, n of the passages that are there. Terms are picked behind the join: who doesn't read them doesn't shuffle them."""
        lists = self._read("postings", "key string, terms array<string>, counts array<bigint>").join(self.alive(), ["key", "version"], "left_semi")
        return lists.select("key", "terms", F.posexplode("counts").alias("at", "n")).select("key", F.get("terms", "at").alias("term"), "n")


def _block(key: str, count: int):
    return F.pmod(F.xxhash64(key), F.lit(max(1, count))).cast("int")


def _every(count: int):
    return F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1)))


def _blocks(df: DataFrame, key: str, size: int) -> int:
    return -(-df.select(key).distinct().count() // size)


class Keywords:
    """Keyword scores of ``queries`` (query_key, text) with ``docs`` (doc_key, text): cosine of their tf-idf vectors, for documents that share a term."""

    def __init__(self, docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text"):
        self.doc_key, self.query_key = doc_key, query_key
        with sparing(docs.sparkSession):
            self._store(docs, queries, text)

    def _store(self, docs: DataFrame, queries: DataFrame, text: str) -> None:
        doc_key, query_key = self.doc_key, self.query_key
        q = terms(queries.where(F.col(query_key).isNotNull()), query_key, text).select(query_key, F.xxhash64("term").alias("term"), "n")
        q = write_shared(q, "query-terms")
        rows, idf = weighted_terms(docs.where(F.col(doc_key).isNotNull()), doc_key, q.select("term").distinct(), text)
        n_rows, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        self.doc_blocks, self.query_blocks = max(-(-n_rows // DOC_BLOCK), -(-n_terms // TERM_BLOCK)), _blocks(queries, query_key, WORD_QUERY_BLOCK)
        q = q.join(idf, "term").withColumn("w", (1 + F.ln("n")) * F.col("idf"))
        q = q.groupBy(F.col(query_key).alias("query")).agg(F.sqrt(F.sum(F.pow("w", 2))).alias("norm"), F.collect_list(F.struct("number", "w", "idf")).alias("t"))
        self.queries = write_shared(q.select(_block("query", self.query_blocks).alias("query_block"), "query", F.col("t.number").alias("terms"),
                                             F.transform("t", lambda x: x["w"] / F.col("norm")).alias("weights"), F.col("t.idf").alias("idfs")), "queries")
        self.rows = rows.select(_block(doc_key, self.doc_blocks).alias("block"), F.col(doc_key).alias("doc"), "norm", "terms", "counts", _every(self.query_blocks).alias("query_block"))
        self.doc_type = rows.schema[doc_key].dataType.simpleString()

    @staticmethod
    def _lists(queries: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, dict]:
        """Documents in order, and for every term of the queries its documents' places and weights, the greatest first."""
        rows = rows.sort_values("doc")
        asked, first = np.unique(np.concatenate(queries["terms"].to_list()), return_index=True)
        idf = np.concatenate(queries["idfs"].to_list())[first]
        numbers, counts = np.concatenate(rows["terms"].to_list()), np.concatenate(rows["counts"].to_list())
        place = np.repeat(np.arange(len(rows)), rows["terms"].map(len))
        at = np.minimum(np.searchsorted(asked, numbers), len(asked) - 1)
        keep = asked[at] == numbers
        at, place, counts = at[keep], place[keep], counts[keep]
        impact = (1 + np.log(counts)) * idf[at] / rows["norm"].to_numpy()[place]
        order = np.lexsort((-impact, at))
        at, place, impact = at[order], place[order], impact[order]
        found, cuts = np.unique(at, return_index=True)
        return rows["doc"].to_numpy(), dict(zip(asked[found], zip(np.split(place, cuts[1:]), np.split(impact, cuts[1:]))))

    @classmethod
    def scored(cls, queries: pd.DataFrame, rows: pd.DataFrame, k: int | None) -> Iterator[Found]:
        """(query, documents, scores) of every query: of all documents that share a term, or only of those that can be among the first k."""
        ids, lists = cls._lists(queries, rows)
        total, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for query, names, weights in zip(queries["query"], queries["terms"], queries["weights"]):
            found = sorted(((w * lists[t][1][0], w, *lists[t]) for t, w in zip(names, weights) if t in lists), key=lambda x: -x[0])
            rest = np.cumsum([x[0] for x in found][::-1])[::-1]
            total[:], seen[:] = 0.0, False
            at = None
            for i, (_, w, place, impact) in enumerate(found):
                if at is None and k is not None and i:
                    n = np.count_nonzero(seen)
                    if n >= k and rest[i] < (least := np.partition(total, len(total) - k)[len(total) - k]) - _SLACK:
                        at = np.flatnonzero(total + rest[i] >= least - _SLACK)
                if at is None:
                    total[place] += w * impact
                    seen[place] = True
                else:
                    total[place] += w * impact
                    at = at[total[at] + (rest[i + 1] if i + 1 < len(found) else 0.0) >= np.partition(total[at], len(at) - k)[len(at) - k] - _SLACK]
            at = np.flatnonzero(seen) if at is None else at
            if len(at):
                yield query, ids[at], np.round(total[at], 6)


class Vectors:
    """Dot products of ``queries`` (query_key, embedding) with ``vectors`` (doc_key, embedding)."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, doc_key: str, query_key: str):
        self.doc_key, self.query_key = doc_key, query_key
        self.doc_blocks, self.query_blocks = _blocks(vectors, doc_key, DOC_BLOCK), _blocks(queries, query_key, QUERY_BLOCK)
        self.queries = queries.select(F.col(query_key).alias("query"), F.col("embedding").alias("asked"), _block(query_key, self.query_blocks).alias("query_block"))
        self.queries = self.queries.dropDuplicates(["query"])
        self.rows = vectors.select(F.col(doc_key).alias("doc"), F.col("embedding").alias("embedding"), _block(doc_key, self.doc_blocks).alias("block"), _every(self.query_blocks).alias("query_block"))
        self.doc_type = vectors.schema[doc_key].dataType.simpleString()

    @staticmethod
    def scored(queries: pd.DataFrame, rows: pd.DataFrame, k: int | None) -> Iterator[Found]:
        rows = rows.sort_values("doc")
        ids = rows["doc"].to_numpy()
        table = np.stack(rows["embedding"].to_list()).astype(np.float64) @ np.stack(queries["asked"].to_list()).astype(np.float64).T
        for j, query in enumerate(queries["query"]):
            yield query, ids, np.round(table[:, j], 6)


Source = Keywords | Vectors


# ---------------------------------------------------------------- tasks

def _tasks(source: Source, queries: DataFrame, task: Callable[[Found, object], pd.DataFrame | None], schema: str, k: int | None = None) -> DataFrame:
    """``task`` of every query with every block of documents. ``queries`` may carry further columns for the task."""
    scored, names = source.scored, [c.split(" ")[0] for c in schema.split(", ")]
    keys = ["block", "query_block"]
    # a task for every pair of blocks, so that a task's memory does not grow with the input
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.doc_blocks * source.query_blocks)
    asked, rows = queries.withColumn("block", _every(source.doc_blocks)).repartition(tasks, *keys), source.rows.repartition(tasks, *keys)

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            about = queries.set_index("query")
            for found in scored(queries, rows, k):
                out.append(task(found, about.loc[found[0]]))
        out = [x for x in out if x is not None and len(x)]
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, schema)


def best(source: Source, k: int = TOP_K) -> DataFrame:
    """query_key, doc_key, score, rank of the k best documents of each query."""
    def task(found, _):
        query, docs, scores = found
        at = np.argsort(-scores, kind="stable")[:k]
        return pd.DataFrame({"query": query, "doc": docs[at], "score": scores[at]})
    types = f"query {source.queries.schema['query'].dataType.simpleString()}, doc {source.doc_type}, score double"
    heads = _tasks(source, source.queries, task, types, k).withColumnsRenamed({"query": source.query_key, "doc": source.doc_key})
    return top_k(heads, source.query_key, source.doc_key, k)


def ranks(source: Source, wanted: DataFrame) -> DataFrame:
    """query_key, doc_key, rank of the ``wanted`` pairs among all scored documents (null where not scored), and n: documents scored for the query."""
    q, d = source.query_key, source.doc_key
    kind = f"query {source.queries.schema['query'].dataType.simpleString()}"
    asked = wanted.groupBy(F.col(q).alias("query")).agg(F.collect_list(d).alias("wanted"))  # the heads of two lists

    def score(found, about):
        query, docs, scores = found
        at = np.flatnonzero(np.isin(docs, np.asarray(about["wanted"])))
        return pd.DataFrame({"query": query, "doc": docs[at], "score": scores[at]})
    known = _tasks(source, source.queries.join(asked, "query"), score, f"{kind}, doc {source.doc_type}, score double")
    known = write_shared(known, "wanted-scores").groupBy("query").agg(F.collect_list(F.struct("doc", "score")).alias("w"))
    known = known.select("query", F.col("w.doc").alias("wanted"), F.col("w.score").alias("scores"))

    def count(found, about):
        query, docs, scores = found
        if about["wanted"] is None:
            return pd.DataFrame({"query": [query], "doc": [None], "n": [len(docs)]})
        order = np.sort(scores)
        before = []
        for doc, s in zip(about["wanted"], about["scores"]):
            above = len(order) - int(np.searchsorted(order, s, "right"))
            before.append(above + int(np.count_nonzero(docs[scores == s] < doc)))
        return pd.DataFrame({"query": query, "doc": pd.Series([*about["wanted"], None], dtype=object), "n": [*before, len(docs)]})
    asking = source.queries.join(known, "query", "left")
    counts = _tasks(source, asking, count, f"{kind}, doc {source.doc_type}, n long").groupBy("query", "doc").agg(F.sum("n").alias("n"))
    counts = write_shared(counts, "counts").withColumnsRenamed({"query": q, "doc": d})
    size = counts.where(F.col(d).isNull()).select(q, F.col("n").alias("n"))
    places = counts.where(F.col(d).isNotNull()).select(q, d, (F.col("n") + 1).alias("rank"))
    return wanted.select(q, d).join(places, [q, d], "left").join(size, q, "left")


def fuse(keywords: Keywords, vectors: Vectors, queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_key, doc_key, vector_rank, keyword_rank, score, rank: top k of ``docs`` for each of ``queries`` by the sum of 1 / (60 + rank).

    Documents that share no term with the query have the keyword rank behind all that do; without a vector on either side the vector list
    adds nothing. A document below rank 60 + 2k in both lists scores less than 2 / (120 + 2k) = 1 / (60 + k), which k documents reach, so
    only the heads of the two lists can win; their ranks in the other list are counted exactly. Documents in neither list
    come after all others: the k smallest of ``docs`` stand for them.
    """
    q, d = keywords.query_key, keywords.doc_key
    depth = RRF + 2 * k
    heads = [best(s, depth).select(q, d) for s in (keywords, vectors)]
    first = [r[0] for r in docs.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).limit(k).collect()]
    kind = docs.schema[d].dataType.simpleString()
    heads.append(queries.select(q).distinct().select(q, F.explode(F.array(*map(F.lit, first)).cast(f"array<{kind}>")).alias(d)))
    wanted = write_shared(union_on(heads, q, d).distinct(), "wanted")
    kw = ranks(keywords, wanted).select(q, d, F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1).alias("keyword_rank"))
    j = kw.join(ranks(vectors, wanted).select(q, d, F.col("rank").alias("vector_rank")), [q, d])
    score = F.lit(1.0) / (F.col("keyword_rank") + RRF) + F.coalesce(F.lit(1.0) / (F.col("vector_rank") + RRF), F.lit(0.0))
    return top_k(j.select(q, d, "vector_rank", "keyword_rank", F.round(score, 9).alias("score")), q, d, k)
