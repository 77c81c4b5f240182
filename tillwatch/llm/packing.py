"""Packing of documents into sequences by non-negative least squares over length combinations.

A document's ids are cut into whole sequences and a remainder. Remainders are packed by length alone: combinations of two or three lengths that
fill a sequence exactly (and single lengths that are powers of two, which need no padding) are the columns of a non-negative least-squares problem
against the histogram of lengths. There are hundreds of thousands of them, so columns are generated: the residual prices every length, the best-priced combinations
of each length join, and coordinate descent solves for the repeat counts. Errors are measured in tokens, so a long remainder, which finds room in few
places, weighs more than a short one. Counts are rounded down, and the largest remainders up while their lengths last; the rest is packed greedily, longest first. The histogram has
a bin per length, so this runs on the driver whatever the number of documents. Documents then take their places by their rank among those of
equal length, which is counted in buckets, never in one task.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.tables import store

CAPACITY = 2048
END_ID = 1
MEMORY = 1_200_000
_TAIL = string.punctuation
#: Rounds of column generation and sweeps of coordinate descent in each; a round that prices nothing above TOLERANCE of the largest bin is the last.
ROUNDS, SWEEPS, TOLERANCE = 40, 6, 1e-3
BUCKET_ROWS = 50_000
_TOKENS = "doc_id long, doc_tokens long, salt long, crcs array<long>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plain_parts(word: str) -> int:
    """In how many pre-tokens a word falls if it is letters and then punctuation; 0 for any other word."""
    body = word.rstrip(_TAIL)
    if body and not (body.isalpha() if body.isascii() else body.isalpha() and body.lower().isalpha() and unicodedata.is_normalized("NFC", word)):
        return 0
    return (len(body) > 0) + (len(body) < len(word))


class WordIds:
    """Ids of words by the tokenizers library, remembered within a worker.

    Words are encoded many at a time. Those of letters and punctuation are joined by line ends and told apart by the ids that end a
    pre-token; others are joined by a special token, and those that hold such a token are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.mark = min(self.t.get_added_tokens_decoder().items())
        vocabulary = self.t.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 2, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self):
        self.known = {0: 0}
        self.pool = np.array([END_ID], np.uint32)
        self.of, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, words: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """(order in which the words were encoded, ids, number of ids of each word in that order)."""
        mark_id, mark = self.mark[0], self.mark[1].content
        parts = [plain_parts(w) for w in words]
        groups = [[k for k, n in enumerate(parts) if n], [k for k, n in enumerate(parts) if not n]]
        order, ids, sizes = [], [], []
        for plain, group in zip((True, False), groups):
            for i in range(0, len(group), 2000):
                some = group[i:i + 2000]
                texts = [words[k] for k in some]
                size = None
                if plain:
                    found = self._ids("\n".join(texts))
                    ends = np.flatnonzero(self.ends[found]) + 1
                    last = np.cumsum([parts[k] for k in some])
                    if len(ends) == last[-1] and ends[-1] == len(found):
                        size = np.diff(ends[last - 1], prepend=0)
                elif not any("<|" in x for x in texts):
                    found = self._ids(mark.join(texts))
                    size = np.diff(np.flatnonzero(np.append(found, mark_id) == mark_id), prepend=-1) - 1
                    found = found[found != mark_id]
                if size is None:
                    each = [self._ids(x) for x in texts]
                    found, size = np.concatenate(each), np.array([len(x) for x in each])
                order += some
                ids.append(found.astype(np.uint32))
                sizes.append(size.astype(np.int64))
        return order, ids, sizes

    def slots(self, w: W.Words) -> np.ndarray:
        """A slot of ``of`` and ``size`` for each word; slot 0 is the end id."""
        distinct, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.of) + len(distinct) > MEMORY:
            self.forget()
        known, listed = self.known, distinct.tolist()
        new = [k for k, h in enumerate(listed) if h not in known]
        if new:
            raw = w.data.tobytes()
            order, made, sizes = self._encode([raw[a:b].decode() for a, b in zip(w.start[where[new]].tolist(), w.end[where[new]].tolist())])
            sizes, begin = np.concatenate(sizes), len(self.of)
            self.of = np.concatenate((self.of, len(self.pool) + np.cumsum(sizes) - sizes))
            self.size = np.concatenate((self.size, sizes))
            self.pool = np.concatenate((self.pool, *made))
            known.update(zip([listed[new[k]] for k in order], range(begin, len(self.of))))
        return np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))[back]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def _tokens(path: str, capacity: int):
    def run(batches):
        ids_of = word_ids(path)
        for batch in batches:
            for w in W.slices(batch.column("text")):
                slots = np.insert(ids_of.slots(w), w.first[1:], 0)
                size = ids_of.size[slots]
                ids = ids_of.pool[W.ragged(ids_of.of[slots], size)].astype("<u4")
                bounds = np.concatenate(([0], np.cumsum(size)))[w.first + np.arange(len(w.first))]
                raw, crcs, salt = memoryview(ids).cast("B"), [], []
                for i in range(len(bounds) - 1):
                    cuts = range(int(bounds[i]), int(bounds[i + 1]), capacity)
                    crcs.append([zlib.crc32(raw[4 * b:4 * min(b + capacity, int(bounds[i + 1]))]) for b in cuts])
                    salt.append(crcs[-1][-1] * 2654435761 + i * 40503)
                doc = batch.column("doc_id").slice(w.rows.start, len(crcs))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(bounds)), pa.array([s % (1 << 62) for s in salt], pa.int64()),
                                                  pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "salt", "crcs"])
    return run


def priced(price: np.ndarray, have: np.ndarray, capacity: int) -> np.ndarray:
    """For every available length the best-priced exact combination of three that has it as its shortest, and all of two and of one:
    rows of lengths (ascending, zeros in front) that sum to the capacity, with a positive price."""
    lengths = np.flatnonzero(have)
    ones = [x for x in (1 << np.arange(capacity.bit_length())) if x < capacity and have[x]]
    a = lengths[lengths * 2 <= capacity]
    a = a[have[capacity - a]]
    rows = [np.array([[0, 0, x] for x in ones], np.int64).reshape(-1, 3), np.stack((np.zeros_like(a), a, capacity - a), axis=1)]
    best = []
    for x in lengths[lengths * 3 <= capacity]:
        b = lengths[np.searchsorted(lengths, x):np.searchsorted(lengths, (capacity - x) // 2, "right")]
        b = b[have[capacity - x - b]]
        if len(b):
            y = b[np.argmax(price[b] + price[capacity - x - b])]
            best.append((x, y, capacity - x - y))
    rows.append(np.array(best, np.int64).reshape(-1, 3))
    rows = np.concatenate(rows)
    return rows[(price[rows] * (rows > 0)).sum(axis=1) > 0]


def solve_counts(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], list[float]]:
    """Non-negative least squares: combinations and the repeat counts whose tokens of each length come nearest to the histogram's."""
    weight = (np.arange(len(histogram), dtype=float) ** 2).tolist()
    have = histogram > 0
    columns: dict[tuple[int, ...], int] = {}
    norms: list[float] = []  # a length may occur twice or three times in a combination
    counts: list[float] = []
    rest = histogram.astype(float).tolist()
    least = TOLERANCE * max(histogram.max(initial=0), 1)
    for _ in range(ROUNDS):
        price = np.array(rest) * weight
        found = [tuple(int(v) for v in row if v) for row in priced(price, have, capacity)]
        new = [row for row in found if row not in columns and sum(rest[v] * weight[v] for v in row) > least * weight[row[-1]]]
        if not new:
            break
        for row in new:
            columns[row] = len(counts)
            norms.append(sum(row.count(v) * weight[v] for v in row))
            counts.append(0.0)
        for _ in range(SWEEPS):
            for row, k in columns.items():
                price_of_row = 0.0
                for v in row:
                    price_of_row += rest[v] * weight[v]
                step = price_of_row / norms[k]  # minimises the squared residual along this column
                if step < -counts[k]:
                    step = -counts[k]
                if step:
                    counts[k] += step
                    for v in row:
                        rest[v] -= step
    return list(columns), counts


def _rounded(rows: list[tuple[int, ...]], counts: list[float], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the lengths left suffice for, which they are taken from: rounded down, then the largest remainders up."""
    def take(row, times):
        times = min(times, *(int(left[v]) // row.count(v) for v in row))
        for v in row:
            left[v] -= times
        return max(times, 0)
    given = {k: take(rows[k], int(counts[k])) for k in sorted(range(len(rows)), key=lambda k: -counts[k]) if counts[k] >= 1}
    for k in sorted(range(len(rows)), key=lambda k: -(counts[k] % 1)):
        if counts[k] % 1 > 1e-9:
            given[k] = given.get(k, 0) + take(rows[k], 1)
    return [(rows[k], n) for k, n in given.items() if n]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) for all remainders; ``histogram``[l] documents have a remainder of l ids. Sequences that are full, or a power of two,
    come from the least squares, the others from the greedy rest."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    out += _rounded(*solve_counts(left, capacity), left)
    sizes = list(np.flatnonzero(left))
    while sizes:
        row, room, at = [], capacity, len(sizes)
        while at > 0:
            v = int(sizes[at - 1])
            if v > room:
                at = int(np.searchsorted(sizes, room, "right"))
                continue
            take = min(int(left[v]), room // v)
            row += [v] * take
            room -= take * v
            at -= 1
        times = min(int(left[v]) // row.count(v) for v in set(row))
        out.append((tuple(row), times))
        for v in row:
            left[v] -= times
        sizes = [s for s in sizes if left[s]]
    return out


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(length << 40 | first rank, sequence of that rank, offset), sorted, and the number of sequences."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for row, times in sequences:
        offset = 0
        for v in row:
            rows.append((v << 40 | given.get(v, 0), base, offset))
            given[v] = given.get(v, 0) + times
            offset += v
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), base


def _place(shared, capacity: int):
    def run(batches):
        keys, sequence, offset, n_short = shared.value
        for batch in batches:
            tokens, rank, full_at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_tokens", "rank", "full_at"))
            rest, full = tokens % capacity, tokens // capacity
            count = full + (rest > 0)
            doc = np.repeat(np.arange(len(tokens)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = nth == full[doc]
            if len(keys):
                want = (rest << 40) | rank
                at = np.maximum(np.searchsorted(keys, want, "right") - 1, 0)
                in_seq, place = sequence[at] + (want - keys[at]), offset[at]
            else:
                in_seq = place = np.zeros(len(tokens), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(nth * capacity), pa.array(np.where(short, rest[doc], capacity)),
                 batch.column("crcs").flatten(), pa.array(tokens[doc]),
                 pa.array(np.where(short, in_seq[doc], n_short + full_at[doc] + nth)), pa.array(np.where(short, place[doc], 0))],
                names=[c.split()[0] for c in _PIECES.split(", ")])
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of every document.

    A document's ids are those of the vocabulary file ``path`` with END_ID after them; null text is the end id alone. Repeated rows are packed as often as they occur. An empty
    table gives no pieces. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = store(rows.mapInArrow(_tokens(path, capacity), _TOKENS), "tokens")
    buckets = max(1, -(-tokens.count() // BUCKET_ROWS))
    tokens = tokens.withColumns({"bucket": F.pmod(F.xxhash64("salt"), F.lit(buckets)), "rest": F.col("doc_tokens") % capacity,
                                 "full": F.floor(F.col("doc_tokens") / capacity)})
    sizes = tokens.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity, np.int64)
    for r in sizes.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    table = slots(plan(histogram, capacity))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("rest", "bucket", F.coalesce(F.sum("n").over(before(Window.partitionBy("rest").orderBy("bucket"))), F.lit(0)).alias("rank_base"))
    fulls = tokens.groupBy("bucket").agg(F.sum("full").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("full_base"))  # a row per bucket
    in_bucket = Window.partitionBy("bucket").orderBy("salt", "doc_id")
    placed = (
        tokens.withColumn("full_at", F.coalesce(F.sum("full").over(before(in_bucket)), F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "rest").orderBy("salt", "doc_id")) - 1)
        .join(ranks, ["rest", "bucket"]).join(fulls, "bucket")
        .select("doc_id", "doc_tokens", "crcs", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("full_at") + F.col("full_base")).alias("full_at"))
    )
    return placed.mapInArrow(_place(docs.sparkSession.sparkContext.broadcast(table), capacity), _PIECES)
