"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose share of something (symbols, repeated words, repeated lines, capitals) reaches a cutoff. Cutoffs are not guessed: labelled
documents that pass the base rule are held out from everything else, and for every stratum and rule the cutoffs are tested from the mildest to the
strictest. The hypothesis "more than risk / rules of the good documents of this stratum are rejected" is given up only if the exact binomial
probability of so few rejections is at most error / (strata * rules); the first cutoff that fails ends the sequence.

* **Multiple testing.** A fixed sequence needs no correction along its cutoffs; strata and rules are corrected by Bonferroni. So with a
  probability of 1 - error at least, in all strata at once, all rules together reject at most ``risk`` of the good documents.
* **Choice.** All certified cutoffs hold at once, so the one that rejects most low-quality documents, less ``cost`` times the good ones, may
  be chosen on the same labels. A rule that gains nothing, and a stratum with too few labels to certify anything, rejects nothing.

Counting covers all labelled documents and is an aggregation; what is tested has a row per stratum, rule and cutoff.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.tables import store

#: Rule: (count, out of); the cutoffs are thousandths, the mildest first.
RULES = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"),
         "capitals": ("n_capitals", "word_chars")}
CUTOFFS = (800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
RISK, ERROR, COST = 0.05, 0.05, 2
MIN_WORDS, MAX_REPEATS = 50, 50
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOLS, _CAPITALS = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_LEADS, _BLANKS = 1 - _table(bytes(range(128, 192))), _table(b" \t\n\v\f\r")


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One key for (document, hash)."""
    return W.mix(hashes ^ W.mix(doc.astype(np.uint64) + np.uint64(1)))


def _repeat_words(w: W.Words, window: int) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it."""
    doc = w.doc
    starts = np.flatnonzero(np.arange(len(doc)) + window <= w.first[1:][doc]) if len(doc) else np.zeros(0, np.int64)
    key = _in_doc(W.Spans(w.hash, 1).of(starts, starts + window), doc[starts])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    marks = np.zeros(len(doc) + 1, np.int64)
    np.add.at(marks, starts[often], 1)
    np.add.at(marks, starts[often] + window, -1)
    return _per_doc(np.cumsum(marks[:-1]) > 0, w.first)


def _lines(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them equal to an earlier line) of each document."""
    docs = len(w.offsets) - 1
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate((w.offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, w.offsets[1:])))
    filled = np.concatenate(([0], np.cumsum(1 - _BLANKS[w.data])))
    use = filled[end] > filled[start]
    start, end = start[use], end[use]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    key = np.sort(_in_doc(W.byte_hashes(w.data, start, end), doc))
    lines = np.bincount(doc, minlength=docs)
    first = np.unique(_in_doc(W.byte_hashes(w.data, start, end), doc), return_index=True)[1] if len(key) else np.zeros(0, np.int64)
    return lines, lines - np.bincount(doc[first], minlength=docs)


def _counted(window: int):
    def run(batches):
        for batch in batches:
            for w in W.slices(batch.column("text")):
                lines, repeated = _lines(w)
                per_byte = [_per_doc(t[w.data], w.offsets) for t in (_LEADS - _BLANKS, _SYMBOLS, _CAPITALS)]
                values = (w.counts, *per_byte, lines, repeated, _repeat_words(w, window))
                keep = [batch.column(i).slice(w.rows.start, len(w.counts)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(keep + [pa.array(v.astype(np.int64)) for v in values], names=batch.schema.names[:-1] + list(COUNTS))
    return run


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", window: int = WINDOW) -> DataFrame:
    """doc_id, stratum and the counts: words (runs of anything but space and tab to carriage return), code points in words, symbols, capitals
    (A-Z), lines with a word, lines equal to an earlier one, words in windows of three that recur in the text. Null text counts as empty, a null
    stratum as ``und``. Lines are cut at line feeds and compared whole, blanks included. Further columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(window), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k successes in n trials of probability p."""
    if k >= n or p <= 0.0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > 0.0 and (i > n * p or term > total * 1e-17):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
    return min(total, 1.0)


def _tested(share: float):
    def run(frames):
        for rows in frames:
            rows["p_value"] = [at_most(int(k), int(n), share) if n else 1.0 for k, n in zip(rows["good_out"], rows["good"])]
            yield rows
    return run


def level(rule: str):
    """How many cutoffs a document reaches."""
    count, out_of = RULES[rule]
    return F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: (F.col(out_of) > 0) & (F.col(count) * 1000 >= c * F.col(out_of)))).cast("long")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATS)


def certified_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cost: int = COST) -> DataFrame:
    """stratum, rule, cutoff, good, good_out, bad, bad_out, p_value: the chosen cutoff of each stratum and rule that has one.

    ``counts`` is ``text_counts``; ``labels`` has doc_id and quality (1 good, 0 low). Labels without id or quality are not read; a document labelled
    several times is good if all labels say so. Documents that fail the base rule take no part.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    judged = counts.where(~base_failed()).join(judged, "doc_id")
    found = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES]))
    of = lambda q: F.sum((F.col("quality") == q).cast("long"))
    tally = judged.select("stratum", "quality", found.alias("x")).groupBy("stratum", "x.rule", "x.level").agg(of(1).alias("g"), of(0).alias("b"))
    tally = store(tally, "tally")
    strata = max(1, tally.select("stratum").distinct().count())
    every = tally.groupBy("stratum", "rule").agg(F.sum("g").alias("good"), F.sum("b").alias("bad")).select(
        "*", F.posexplode(F.array(*map(F.lit, CUTOFFS))).alias("place", "cutoff"))
    reached = F.col("level") + F.col("place") >= len(CUTOFFS)  # a document reaches the strictest cutoffs first
    steps = every.join(tally, ["stratum", "rule"]).groupBy("stratum", "rule", "place", "cutoff", "good", "bad").agg(
        F.sum(F.when(reached, F.col("g")).otherwise(0)).alias("good_out"), F.sum(F.when(reached, F.col("b")).otherwise(0)).alias("bad_out"))
    schema = "stratum string, rule string, place int, cutoff int, good long, bad long, good_out long, bad_out long, p_value double"
    tested = steps.mapInPandas(_tested(risk / len(RULES)), schema)
    sequence = Window.partitionBy("stratum", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("worst", F.max("p_value").over(sequence)).where(F.col("worst") <= error / (strata * len(RULES)))
    gain = F.col("bad_out") - cost * F.col("good_out")
    order = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "place")
    best = passed.withColumn("gain", gain).where("gain > 0").withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("stratum", "rule", "cutoff", "good", "good_out", "bad", "bad_out", "p_value")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cost: int = COST) -> DataFrame:
    """doc_id, stratum, the counts (see ``text_counts``), base_failed, reasons (array of the rules that reject it) and kept for every row of ``docs``.

    Documents need doc_id, text and lang. With too few labels, or none, only the base rule decides. Null and empty texts fail the base
    rule. Repeated rows stay repeated and are judged alike; rows without doc_id are judged but have no label. Further columns are not read.
    """
    counts = store(text_counts(docs), "counts")
    cutoffs = certified_cutoffs(counts, labels, risk, error, cost)
    by_rule = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # one entry a rule
    joined = counts.join(store(by_rule, "cutoffs"), "stratum", "left")
    hit = [F.when(F.col(a) * 1000 >= F.col("cutoffs")[r] * F.col(b), F.lit(r)) for r, (a, b) in sorted(RULES.items())]
    out = joined.withColumn("base_failed", base_failed()).withColumn("reasons", F.filter(F.array(*hit), lambda r: r.isNotNull()))
    return out.select("doc_id", "stratum", *COUNTS, "base_failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"),
                      (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))
