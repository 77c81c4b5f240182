"""Phrase collocations with direct-address tiling.

Words of a stratum are numbered by falling frequency. Two neighbouring numbers are a pair, and a pair is a cell of a matrix, which is cut into tiles of
TILE x TILE cells: frequent words meet in few tiles, which are counted in a dense array with one ``bincount``; the pairs of sparse
tiles are sorted as coordinates. Frequent pairs are numbered by frequency again, and two neighbouring (overlapping) phrases of k words are a pair that is a
phrase of k + 1 words, so every length is the same step.

* **Chunks.** Texts become chunks of codes with a dictionary of their own. A chunk then gets the numbers of the frequent phrases it holds: from a table
  sent to all tasks while that has at most MAX_SENT rows and SENT_BYTES, beyond that by joins, so nothing unbounded travels to all tasks.
  What is not frequent breaks the sequence, and sequences shrink from length to length.
* **Counts** are summed per chunk, then per task, then by key: one row per chunk for a word that a third of all texts hold. A phrase is counted only where its
  first and its last words less one are frequent themselves, which loses nothing, as a phrase is never more frequent than its parts.
* Numbers are row numbers over range partitions; nothing is ordered in one task.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.prefix import numbered
from tillwatch.llm import words as W
from tillwatch.llm.tables import store

TILE = 1024
#: Pairs that make a tile dense; bytes of text that are cut into words at a time, and of a chunk.
DENSE, SLICE_BYTES, CHUNK_BYTES = TILE * TILE // 32, 1 << 19, 4 << 20
#: Phrases of one length, and bytes of their text, that may be sent to all tasks (as 24 bytes each); more are joined by a shuffle.
MAX_SENT, SENT_BYTES = 200_000, 32 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = "chunk long, stratum string, n_tokens long, codes binary, hashes binary, words array<string>, counts array<long>"


def _sequence(values: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """int32 ``values`` with -1 before every place that ``breaks`` marks."""
    out = np.full(len(values) + int(breaks.sum()), -1, np.int32)
    out[np.arange(len(values)) + np.cumsum(breaks)] = values
    return out


def _packed(codes: np.ndarray) -> bytes:
    """Codes in two bytes each where that is enough, after a byte that tells."""
    if codes.max(initial=-1) < 65535:
        return b"\2" + codes.astype(np.uint16).tobytes()  # -1 becomes 65535
    return b"\4" + codes.astype(np.int32).tobytes()


def _unpacked(buffer) -> np.ndarray:
    if bytes(buffer[:1]) == b"\4":
        return np.frombuffer(buffer, np.int32, offset=1).copy()
    codes = np.frombuffer(buffer, np.uint16, offset=1).astype(np.int32)
    codes[codes == 65535] = -1
    return codes


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(codes with -1 between pieces, hashes, counts, words as an Arrow array) of a run of documents."""
    kind = _KIND[data]
    word = kind == 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    piece = np.concatenate(([0], np.cumsum(kind == 2)))[start] + np.searchsorted(offsets, start, "right")
    hashes = W.byte_hashes(data, start, end, fold=True)
    own, at, code, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size = end[at] - start[at]
    text = _LOWER[data[W.ragged(start[at], size)]]
    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    names = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(text))
    breaks = np.ones(len(start), bool)
    breaks[1:] = piece[1:] != piece[:-1]
    return _sequence(code.astype(np.int32), breaks), own, n, names


def _chunk(stratum: str, parts: list) -> dict:
    """One chunk of several runs of documents with a common dictionary."""
    own, at, place = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[2] for p in parts]), len(own)).astype(np.int64)
    first, codes = 0, []
    for p in parts:
        to = np.append(place[first:first + len(p[1])], -1).astype(np.int32)  # -1 stays -1
        codes.append(to[p[0]])
        first += len(p[1])
    names = pa.concat_arrays([p[3] for p in parts]).take(pa.array(at))
    return {"chunk": uuid.uuid4().int >> 65, "stratum": stratum, "n_tokens": int(counts.sum()), "codes": _packed(np.concatenate(codes)),
            "hashes": own.tobytes(), "words": names, "counts": counts}


def _chunks(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        strata = batch.column("stratum").dictionary_encode()
        which = strata.indices.to_numpy(zero_copy_only=False)
        for k, stratum in enumerate(strata.dictionary.to_pylist()):
            texts = batch.column("text").take(pa.array(np.flatnonzero(which == k)))
            parts, size, rows = [], 0, []
            for _, data, offsets in W.text_slices(texts, SLICE_BYTES):
                parts.append(_tokens(data, offsets))
                size += len(data)
                if size >= CHUNK_BYTES:
                    rows, parts, size = [*rows, parts], [], 0
                    yield _chunk_batch(stratum, rows.pop())
            if parts:
                yield _chunk_batch(stratum, parts)


def _chunk_batch(stratum: str, parts: list) -> pa.RecordBatch:
    row = _chunk(stratum, parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([row["chunk"]], pa.int64()), pa.array([stratum], pa.string()), pa.array([row["n_tokens"]], pa.int64()), pa.array([row["codes"]], pa.binary()),
         pa.array([row["hashes"]], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(row["words"])], pa.int32()), row["words"].cast(pa.string())),
         pa.array([row["counts"]], pa.list_(pa.int64()))],
        names=["chunk", "stratum", "n_tokens", "codes", "hashes", "words", "counts"])


def shortened(ids: np.ndarray) -> np.ndarray:
    """Sequences of ids (-1: none) of two and more, with one -1 after each."""
    some = ids >= 0
    left, right = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    left[1:], right[:-1] = some[:-1], some[1:]
    keep = some & (left | right)
    ended = np.zeros(len(ids), bool)
    ended[1:] = ~some[1:] & keep[:-1]
    return ids[keep | ended]


def _state(chunk: int, ids: np.ndarray) -> pa.RecordBatch:
    """A row of a chunk: codes (frequency ranks within the chunk) and the number that every code stands for."""
    ids = shortened(ids)
    names, codes = np.unique(ids, return_inverse=True)
    none = int(len(names) > 0 and names[0] < 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([_packed(codes.astype(np.int32) - none)], pa.binary()), pa.array([names[none:].tobytes()], pa.binary())],
        names=["chunk", "codes", "names"])


def _rows(batch: pa.RecordBatch):
    """(chunk, codes, names, found columns) of every row of a batch."""
    found = batch.schema.get_field_index("found")
    names = batch.schema.get_field_index("names")
    for i in range(batch.num_rows):
        cells = {}
        if found >= 0 and batch.column("found")[i].is_valid:
            values = batch.column("found").slice(i, 1).flatten()
            cells = {values.type.field(j).name: values.field(j).to_numpy(zero_copy_only=False) for j in range(values.type.num_fields)}
        yield (batch.column("chunk")[i].as_py(), _unpacked(batch.column("codes")[i].as_buffer()),
               np.frombuffer(batch.column("names")[i].as_buffer(), np.int64) if names >= 0 else None, cells)


def _words_sent(known: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """stratum -> (hashes of its frequent words, ascending; their numbers). At most MAX_SENT rows."""
    rows, out = known.select("stratum", "phrase", "id").toArrow(), {}
    strata = rows.column("stratum").to_numpy()
    for stratum in set(strata):
        part = rows.filter(pa.array(strata == stratum))
        hashes, ids = _hashes(part.column("phrase")), part.column("id").to_numpy()
        order = np.argsort(hashes)
        out[stratum] = hashes[order], ids[order]
    return out


def _hashes(words) -> np.ndarray:
    data, offsets = W.text_buffers(words)
    return W.byte_hashes(data, offsets[:-1], offsets[1:]) if len(data) else np.zeros(len(offsets) - 1, np.uint64)


def _look_up_words(sent):
    def run(batches):
        for batch in batches:
            for i, (chunk, codes, _, _) in enumerate(_rows(batch)):
                known, ids = sent.value.get(batch.column("stratum")[i].as_py(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                own = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
                to = np.full(len(own) + 1, -1, np.int64)  # the last stands for a break
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    to[:-1] = np.where(known[at] == own, ids[at], -1)
                yield _state(chunk, to[codes])
    return run


def _number_words(batches):
    for batch in batches:
        for chunk, codes, _, found in _rows(batch):
            to = np.full(max(int(codes.max(initial=-1)), 0) + 2, -1, np.int64)
            to[found["code"]] = found["id"]
            yield _state(chunk, to[codes])


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of pairs, key of each pair)."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    return at, (codes[at].astype(np.int64) << 32) | codes[at + 1]


def count_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of neighbouring codes: dense tiles by ``bincount``, the others by sorting coordinates."""
    at, key = _cells(codes)
    a, b = codes[at].astype(np.int64), codes[at + 1].astype(np.int64)
    side = int(max(a.max(initial=0), b.max(initial=0))) // TILE + 1
    tile = (a // TILE) * side + b // TILE
    tiles, size = np.unique(tile, return_counts=True)
    out, sparse = [], np.ones(len(tile), bool)
    for t in tiles[size >= DENSE]:
        inside = tile == t
        sparse &= ~inside
        table = np.bincount((a[inside] % TILE) * TILE + b[inside] % TILE, minlength=TILE * TILE)
        cell = np.flatnonzero(table)
        out.append((t // side * TILE + cell // TILE, t % side * TILE + cell % TILE, table[cell]))
    cell, n = np.unique(key[sparse], return_counts=True)
    out.append((cell >> 32, cell & 0xFFFFFFFF, n))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pairs(batches):
    for batch in batches:
        for chunk, codes, names, _ in _rows(batch):
            a, b, n = count_pairs(codes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), chunk)), pa.array(names[a]), pa.array(names[b]), pa.array(n)],
                                             names=["chunk", "a", "b", "n"])


def _renumbered(chunk: int, codes: np.ndarray, names: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The chunk with the numbers ``ids`` of the pairs (a, b) in place of its pairs; others break the sequence."""
    first, second = (np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0)) for x in (a, b))
    here = (names[first] == a) & (names[second] == b) if len(names) else np.zeros(len(a), bool)
    keys, ids = (first[here].astype(np.int64) << 32) | second[here], ids[here]
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    out = np.full(len(codes), -1, np.int64)
    if len(keys):
        at, key = _cells(codes)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        out[at[hit]] = ids[place[hit]]
    return _state(chunk, out)


def _look_up_pairs(sent):
    def run(batches):
        for batch in batches:
            for chunk, codes, names, _ in _rows(batch):
                yield _renumbered(chunk, codes, names, *sent.value)
    return run


def _number_pairs(batches):
    for batch in batches:
        for chunk, codes, names, found in _rows(batch):
            yield _renumbered(chunk, codes, names, found["a"], found["b"], found["id"])


def _size(known: DataFrame) -> tuple[int, bool]:
    """(phrases, whether they may be sent to all tasks)."""
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    return n, n <= MAX_SENT and size <= SENT_BYTES


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", stratum_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(stratum, words, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, and (stratum, n): all words."""
    send = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = store(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    totals = chunks.groupBy("stratum").agg(F.sum("n_tokens").alias("n"))
    held = chunks.select("chunk", "stratum", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select(
        "chunk", "stratum", "code", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    counted = held.groupBy("stratum", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    known = store(numbered(counted, [F.col("stratum"), F.desc("f"), F.col("phrase")], "id"), "phrases")
    n, small = _size(known)
    types = "chunk long, codes binary, names binary"
    if small:
        state = chunks.select("chunk", "stratum", "codes", "hashes").mapInArrow(_look_up_words(send(_words_sent(known))), types)
    else:
        found = held.join(known.select("stratum", "phrase", "id"), ["stratum", "phrase"]).groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("found"))
        state = chunks.select("chunk", "codes").join(found, "chunk").mapInArrow(_number_words, types)
    levels = [known.select("stratum", F.lit(1).alias("words"), "phrase", "f")]
    for words in range(2, longest + 1):
        if not n:
            break
        state = store(state.where(F.length("codes") > 1), "sequences")
        pairs = state.mapInArrow(_pairs, "chunk long, a long, b long, n long")
        counted = pairs.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        first, last = (known.select(F.col("id").alias(x), F.col("stratum"), F.col("phrase").alias(f"phrase_{x}")) for x in "ab")
        named = counted.join(first, "a").join(last.drop("stratum"), "b").select(
            "stratum", "a", "b", "f", F.concat_ws(" ", "phrase_a", F.substring_index("phrase_b", " ", -1)).alias("phrase"))
        known = store(numbered(named, [F.col("stratum"), F.desc("f"), F.col("phrase")], "id"), "phrases")
        n, small = _size(known)
        levels.append(known.select("stratum", F.lit(words).alias("words"), "phrase", "f"))
        if words < longest and n and small:
            sent = known.select("a", "b", "id").toArrow()
            state = state.mapInArrow(_look_up_pairs(send(tuple(sent.column(c).to_numpy() for c in ("a", "b", "id")))), types)
        elif words < longest and n:
            found = pairs.join(known.select("a", "b", "id"), ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "id")).alias("found"))
            state = state.join(found, "chunk").mapInArrow(_number_pairs, types)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return store(out, "levels"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each stratum.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, pieces into words at spaces and tabs. Candidates are phrases
    of 2 to ``longest`` words that occur a >= ``least`` times, overlaps included. Cut after k words, the parts occur l and r times and the score
    is floor(1000 a n / (l r)), n being all words of the stratum; the lowest score counts, ties to the smallest k. A candidate that lies in a
    longer candidate as frequent as itself is dropped. Greatest score first, then a, then the phrase in byte order. Decimals of 38 digits hold the products.

    Null texts count as empty, a null stratum as ``und``; empty tables give no rows. Texts of any length are worked on whole. Repeated rows count
    as often as they occur. Further columns are not read, whatever their names.
    """
    known, totals = frequent_phrases(docs, least, longest, text_col, stratum_col)
    longer = known.where("words > 1")
    parts = F.split("phrase", " ")
    cuts = longer.select("stratum", "words", "phrase", F.col("f").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("stratum", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    of = lambda part, name: known.select("stratum", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("head", "l"), ["stratum", "head"]).join(of("tail", "r"), ["stratum", "tail"]).join(totals, "stratum")
    exact = lambda *c: " * ".join(f"cast({x} as decimal(38,0))" for x in c)
    score = F.expr(f"({exact('1000', 'a', 'n')}) div ({exact('l', 'r')})")
    scored = cuts.withColumn("score", score).groupBy("stratum", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = longer.where("words > 2").select("stratum", F.col("f").alias("a"), parts.alias("w")).select(
        "stratum", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w")), " "))).alias("phrase"))
    left = scored.join(inner.distinct(), ["stratum", "phrase", "a"], "left_anti")
    order = Window.partitionBy("stratum").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("stratum").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                         "n", F.col("cut.score").alias("score"))
