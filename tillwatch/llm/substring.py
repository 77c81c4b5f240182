"""Substring de-duplication with difference-cover anchors.

A window of ``window`` words is repeated if its word sequence starts anywhere else, in the same document too. Only words at
places whose remainder modulo ``period`` lies in a difference cover start an anchor, a hash of window - period + 1 words. For any
two places there is a shift below the period at which both are in the cover, so two equal windows share at least one aligned anchor
inside them; anchors that occur once rule out their windows. Anchors that recur are extended:

1. Anchors are counted by their hash alone. Those that recur are marked in a bit table of fixed size, and only they travel on, with their places.
2. The context of an anchor is all words any window around it can hold. Two anchors with equal contexts
   prove every window in the context repeated, at once.
3. Where contexts differ, one anchor of each distinct context compares its windows by a 128-bit hash.

Copies within one Arrow batch are settled there and only one of them travels on. Contexts are counted by combinable aggregations, so a passage that a third of
all documents hold is reduced before it is shuffled. Only texts that a bit table lets through are shuffled. Nothing forms pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.sieve import may_hold, sieve
from tillwatch.llm.tables import row_key, store

WINDOW = 35
# Perfect difference sets by period; every difference modulo the period is one of two members'.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
_ANCHOR = "key_high long, key_low long, place int, anchor long, context long, times int, settled boolean"
_WINDOW = "key_high long, key_low long, place int, one long, two long, times int, settled boolean"


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length): the longest period that leaves anchors of two fifths of the window."""
    period = max(p for p in COVERS if window - p + 1 >= max(1, -(-2 * window // 5)))
    return period, COVERS[period], window - period + 1


def _settle(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, times, settled): of equal pairs the first travels, counted twice; the others are settled and get scattered keys."""
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    settled, times = np.zeros(len(one), bool), np.ones(len(one), np.int32)
    settled[order[1:][same]] = True
    times[order[:-1][same]] = 2
    key = np.where(settled, W.mix(one + np.arange(len(one), dtype=np.uint64)), one)
    return key, times, settled


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def _gathered(parts: list[dict], pair: tuple[str, str]) -> pa.RecordBatch:
    joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    joined[pair[0]], joined["times"], joined["settled"] = _settle(joined[pair[0]], joined[pair[1]])
    return _table(joined)


def _at_cover(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, place in it, words of it, hash) of every anchor."""
    period, cover, length = cover_of(window)
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    doc = w.doc
    place, size = w.place(doc), w.counts[doc]
    at = np.flatnonzero(in_cover[place % period] & (place + length <= size) & (size >= window))
    return at, doc[at], place[at], size[at], W.Spans(w.hash, 1).of(at, at + length)


def _anchor_counts(window: int):
    def run(batches):
        for batch in batches:
            for w in W.slices(batch.column("text")):
                anchor, n = np.unique(_at_cover(w, window)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])
    return run


def _anchors(window: int, often):
    period, _, length = cover_of(window)
    reach = period - 1

    def run(batches):
        for batch in batches:
            high, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key_high", "key_low"))
            parts = []
            for w in W.slices(batch.column("text")):
                found = _at_cover(w, window)
                at, doc, place, size, anchor = (x[may_hold(often.value, found[4])] for x in found)
                if not len(at):
                    continue
                left = np.minimum(place, reach)
                right = np.minimum(size - place, length + reach)
                sides = (left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64)
                context = W.mix(W.Spans(w.hash, 2).of(at - left, at + right) + sides * np.uint64(0x9E3779B97F4A7C15))
                own = doc + w.rows.start
                parts.append({"key_high": high[own], "key_low": low[own], "place": place.astype(np.int32), "anchor": anchor, "context": context})
            if parts:
                yield _gathered(parts, ("anchor", "context"))
    return run


def _windows(window: int):
    period, _, _ = cover_of(window)

    def run(batches):
        for batch in batches:
            high, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key_high", "key_low"))
            lists = batch.column("unsettled")
            parts = []
            for w in W.slices(batch.column("text")):
                rows = lists.slice(w.rows.start, w.rows.stop - w.rows.start)
                doc = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
                at = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + w.first[doc]
                marks = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(marks, np.maximum(at - period + 1, w.first[doc]), 1)
                np.add.at(marks, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                of = np.searchsorted(w.first, starts, "right") - 1
                fits = starts + window <= w.first[of + 1]
                starts, of = starts[fits], of[fits]
                if not len(starts):
                    continue
                own = of + w.rows.start
                parts.append({"key_high": high[own], "key_low": low[own], "place": (starts - w.first[of]).astype(np.int32),
                              "one": W.Spans(w.hash, 1).of(starts, starts + window),
                              "two": W.Spans(w.hash, 2).of(starts, starts + window)})
            if parts:
                yield _gathered(parts, ("one", "two"))
    return run


def _let_through(table, keep: bool = True):
    """Rows whose key may be in the set, or else those that are certainly not."""
    def run(batches):
        for batch in batches:
            held = may_hold(table.value, batch.column("key_high").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(held if keep else ~held))
    return run


def _asked(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is in ``keys``, with its further columns; only rows that may have one are shuffled."""
    table = keyed.sparkSession.sparkContext.broadcast(sieve(keys, "key_high"))
    return keyed.mapInArrow(_let_through(table), keyed.schema).join(keys, ["key_high", "key_low"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Key of each row (see ``row_key``) with ``starts`` and ``ends``: spans of words, partly overlapping, that repeated windows
    cover. Rows without any are missing; equal rows have one key and one row here. Stored."""
    period, _, length = cover_of(window)
    sent = docs.sparkSession.sparkContext.broadcast
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).where(F.length("text") >= 2 * window - 1)
    key = ["key_high", "key_low"]
    counts = keyed.select("text").mapInArrow(_anchor_counts(window), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = sent(sieve(counts.where("n > 1"), "anchor"))
    anchors = store(keyed.mapInArrow(_anchors(window, often), _ANCHOR), "anchors")
    often.unpersist()
    contexts = anchors.where("not settled").groupBy("anchor", "context").agg(F.sum("times").alias("n_context"), F.min(F.struct(*key, "place")).alias("first"))
    contexts = store(contexts, "contexts")
    recurring = contexts.groupBy("anchor").agg(F.sum("n_context").alias("n")).where("n > 1")
    shared = contexts.where("n_context > 1").select("anchor", "context")
    proven = anchors.where("not settled").join(shared, ["anchor", "context"]).select(*key, "place").unionByName(
        anchors.where("settled").select(*key, "place"))
    asking = contexts.join(recurring, "anchor").where("n_context < n").select("first.*")
    asking = store(asking.groupBy(*key).agg(F.collect_set("place").alias("unsettled")), "asking")
    windows = _asked(keyed, asking).mapInArrow(_windows(window), _WINDOW)
    found = windows.withColumn("n", F.sum("times").over(Window.partitionBy("one", "two"))).where("n > 1 or settled")
    span = lambda df, before: df.select(*key, F.struct(F.greatest(F.col("place") - before, F.lit(0)).alias("start"), (F.col("place") + window).alias("end")).alias("span"))
    spans = span(proven, period - 1).unionByName(span(found, 0)).groupBy(*key).agg(F.collect_set("span").alias("spans"))
    return store(spans.select(*key, F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")), "spans")


def _kept(batch: pa.RecordBatch, starts: pa.Array, ends: pa.Array) -> dict:
    """n_words, n_removed and the words outside the spans, joined by one space."""
    out = {"n_words": [], "n_removed": [], "kept": []}
    for w in W.slices(batch.column("text")):
        n = len(w.hash)
        marks = np.zeros(n + 1, np.int64)
        for lists, step in ((starts, 1), (ends, -1)):
            rows = lists.slice(w.rows.start, w.rows.stop - w.rows.start)
            doc = np.repeat(np.arange(len(rows)), rows.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))
            at = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(marks, np.minimum(at + w.first[doc], w.first[doc + 1]), step)
        keep = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
        size = w.end[keep] - w.start[keep]
        doc = np.searchsorted(w.first, keep, "right") - 1
        last = np.ones(len(keep), bool)
        last[:-1] = doc[1:] != doc[:-1]
        room = size + ~last
        to = np.concatenate(([0], np.cumsum(room)))
        text = np.full(int(to[-1]), 32, np.uint8)
        text[W.ragged(to[:-1], size)] = w.data[W.ragged(w.start[keep], size)]
        kept = np.bincount(doc, minlength=len(w.first) - 1)
        bounds = to[np.concatenate(([0], np.cumsum(kept)))]
        out["kept"].append(pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)))
        out["n_words"].append(w.counts)
        out["n_removed"].append(w.counts - kept)
    return {"n_words": pa.array(np.concatenate(out["n_words"])), "n_removed": pa.array(np.concatenate(out["n_removed"])),
            "kept": pa.concat_arrays(out["kept"]).cast(pa.string())}


def _cut(batches):
    """Rows without their key and spans, but with the counts and ``kept``."""
    for batch in batches:
        if batch.num_rows:
            data = _kept(batch, batch.column("starts"), batch.column("ends"))
            rest = [c for c in batch.schema.names if c not in ("key_high", "key_low", "starts", "ends")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *data.values()], names=[*rest, *data])


def _uncut(table):
    """As ``_cut``, for the rows that certainly have no span."""
    without = _let_through(table, False)

    def run(batches):
        for batch in without(batches):
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield from _cut([batch.append_column("starts", none).append_column("ends", none)])
    return run


def _with_kept(docs: DataFrame, further: list[str], window: int, text_col: str, id_col: str) -> DataFrame:
    """text, c0, c1, ... (the ``further`` columns), n_words, n_removed, kept; only rows that may have a span are shuffled."""
    spans = repeated_spans(docs, window, text_col, id_col)
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(further)])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[2:]) + ", n_words long, n_removed long, kept string"
    table = docs.sparkSession.sparkContext.broadcast(sieve(spans, "key_high"))
    held = keyed.mapInArrow(_let_through(table), keyed.schema).join(spans, ["key_high", "key_low"], "left")
    return held.mapInArrow(_cut, types).unionByName(keyed.mapInArrow(_uncut(table), types))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, n_words, n_removed, kept: ``kept`` has the words that no repeated window covers, joined by one space.

    Null or empty text has no words and an empty ``kept``. Rows that repeat another row whole are repeats of each other. Texts
    shorter than the window keep all words; long ones are worked on whole. An empty table gives no rows. Other columns of ``docs`` are not
    read, whatever their names.
    """
    cut = _with_kept(docs, [id_col], window, text_col, id_col)
    return cut.select(F.col("c0").cast("long").alias("doc_id"), "text", "n_words", "n_removed", "kept")


def with_repeats_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns: text, and n_chars if there is one, are new where words were removed; every other row and column is left as it is,
    whatever its name. Nulls, short and long texts and repeated rows: see ``remove_repeats``."""
    further = [c for c in docs.columns if c != "text"]
    cut, changed = _with_kept(docs, further, window, "text", "doc_id"), F.col("n_removed") > 0
    back = {c: F.col(f"c{i}") for i, c in enumerate(further)} | {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in back:
        back["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return cut.select(*[back[c].alias(c) for c in docs.columns])
