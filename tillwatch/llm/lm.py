"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, normalised by matrix products.

Tokens are words (A-Z folded) and one end per document. The model predicts the class of a token from the class before it: the TOP
most frequent tokens have a class each, all others share SUFFIXES classes by their last two bytes, in which a word has its smoothed
share of the corpus counts. So probabilities of all known words and one unknown word per suffix class sum to one. The log-bilinear
part, score(w | c) = r_w . q_c + b_w, is fitted to the class pairs of the whole training part (a table of bounded size) by the expectation of
the noise-contrastive objective; one matrix product over all contexts then gives exactly normalised log-probabilities.

Word counts are a distributed table. Of it, only words above a frequency that at most HEAD words reach are sent to the tasks; the rarer
words of each document are joined with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.tables import store

TOP, SUFFIXES, HEAD = 1023, 64, 1 << 18
WIDTH, STEPS, NOISE = 32, 250, 8.0
#: Share of the plain class frequencies in every context, so that a pair never seen costs a bounded amount.
PLAIN = 0.05
END = np.uint64(0x5851F42D4C957F2D)
CLASSES = TOP + SUFFIXES
START = CLASSES
_COUNTS = "word long, suffix int, n long"
_SCORED = ("row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail_tokens long, "
           "tail array<long>, tail_n array<int>")


def suffixes(w: W.Words) -> np.ndarray:
    """Suffix class of each word."""
    fold = np.arange(256)
    fold[65:91] += 32
    last = fold[w.data[w.end - 1]]
    before = np.where(w.end - w.start > 1, fold[w.data[w.end - 2]], 0)
    return (last * 37 + before) % SUFFIXES


def _with_ends(w: W.Words, values: np.ndarray, end) -> np.ndarray:
    return np.insert(values, w.first[1:], end)


def _count(batches):
    for batch in batches:
        words, kinds, sizes = [], [], []
        for w in W.slices(batch.column("text"), fold=True):
            h, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            words.append(h)
            kinds.append(suffixes(w)[at].astype(np.int32))
            sizes.append(n)
        if batch.num_rows:
            h, at, back = np.unique(np.concatenate(words + [np.array([END])]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(sizes + [np.array([batch.num_rows])]))
            kind = np.concatenate(kinds + [np.array([-1], np.int32)])[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(n.astype(np.int64))], names=["word", "suffix", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), suffix, n of every distinct token of ``texts`` (text). Stored."""
    return store(texts.mapInArrow(_count, _COUNTS).groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n")), "counts")


class Corpus:
    """Totals of the training part and its frequent words."""

    def __init__(self, counts: DataFrame, head: int = HEAD, top: int = TOP):
        self.tokens, self.distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
        scale = F.floor(F.log2("n") * 16).cast("int")
        by_size = sorted(((r[0], r[1]) for r in counts.groupBy(scale).agg(F.count(F.lit(1))).collect()), reverse=True)
        total, self.least = 0, None
        for size, n in by_size:
            total += n
            if total > head:
                break
            self.least = size
        self.is_head = scale >= F.lit(self.least if self.least is not None else 1 << 30)
        rows = counts.where(self.is_head | (F.col("word") == F.lit(int(END.view(np.int64))))).toPandas()
        order = np.argsort(rows["word"].to_numpy().view(np.uint64))
        self.words = rows["word"].to_numpy().view(np.uint64)[order]
        self.n = rows["n"].to_numpy()[order]
        kind = rows["suffix"].to_numpy()[order]
        best = np.lexsort((self.words, -self.n))
        best = np.concatenate((np.flatnonzero(self.words == END), best[self.words[best] != END]))[:top]
        self.kind = np.where(kind >= 0, top + kind, 0)
        self.kind[best] = np.arange(len(best))
        self.is_top = np.zeros(len(self.words), bool)
        self.is_top[best] = True
        self.top = top
        sums = {r[0]: (r[1], r[2]) for r in counts.groupBy("suffix").agg(F.sum("n"), F.count(F.lit(1))).collect()}
        self.share = np.zeros(SUFFIXES)
        for j in range(SUFFIXES):
            n, v = sums.get(j, (0, 0))
            mine = self.is_top & (kind == j)
            self.share[j] = (n - self.n[mine].sum()) + 0.5 * (v - mine.sum() + 1)

    def look_up(self, hashes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place among the frequent words or -1) of tokens."""
        if not len(self.words):
            return self.top + suffix, np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        return np.where(known, self.kind[at], self.top + suffix), np.where(known, at, -1)


def _classes(w: W.Words, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, token -> distinct word or -1 for an end, class, place among frequent words), the last two per token."""
    h, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    kind, place = corpus.look_up(h, suffixes(w)[at] if len(h) else np.zeros(0, np.int64))
    end_kind, end_place = corpus.look_up(np.array([END]), np.array([0]))
    return h, _with_ends(w, back, -1), _with_ends(w, kind[back], end_kind[0]), _with_ends(w, place[back], end_place[0])


def _contexts(w: W.Words, kind: np.ndarray) -> np.ndarray:
    before = np.empty(len(kind), np.int64)
    before[1:] = kind[:-1]
    before[w.first[:-1] + np.arange(len(w.first) - 1)] = START
    return before


def _pairs(corpus):
    def run(batches):
        for batch in batches:
            found = []
            for w in W.slices(batch.column("text"), fold=True):
                _, _, kind, _ = _classes(w, corpus.value)
                found.append(np.unique(_contexts(w, kind) * CLASSES + kind, return_counts=True))
            if found:
                pair, back = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in found]))
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])
    return run


def fit(pairs: np.ndarray, counts: np.ndarray, width: int = WIDTH, steps: int = STEPS, noise: float = NOISE, seed: int = 1) -> np.ndarray:
    """log10 P(class | class before): (CLASSES + 1, CLASSES), every row normalised.

    ``noise`` samples per observation come from the class frequencies; all pairs are bounded in number, so the objective's expectation is
    followed, by Adam.
    """
    seen = np.zeros((CLASSES + 1, CLASSES), np.float32)
    seen.ravel()[pairs] = counts
    total = max(float(counts.sum()), 1.0)
    often = seen.sum(axis=1, keepdims=True) / total
    prior = (seen.sum(axis=0) + 0.1) / (total + 0.1 * CLASSES)
    seen /= total
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (CLASSES, width)).astype(np.float32), rng.normal(0, 0.1, (CLASSES + 1, width)).astype(np.float32),
         np.log(prior).astype(np.float32)]
    shift = np.log(noise * prior).astype(np.float32)
    fake = (noise * often * prior).astype(np.float32)
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        real = 1.0 / (1.0 + np.exp(np.clip(shift - (p[1] @ p[0].T + p[2]), -60, 60)))
        slope = seen * (1.0 - real) - fake * real
        grads = [slope.T @ p[1], slope @ p[0], slope.sum(axis=0)]
        rate = 0.1 * (1.0 - 0.9 * step / steps)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    scores = (p[1] @ p[0].T + p[2]).astype(np.float64)
    p_model = np.exp(scores - scores.max(axis=1, keepdims=True))
    p_model /= p_model.sum(axis=1, keepdims=True)
    return np.log10((1.0 - PLAIN) * p_model + PLAIN * prior / prior.sum())


def _score(corpus, table):
    def run(batches):
        c, log_p = corpus.value, table.value
        base_mass = np.log10(c.tokens + 0.5 * (c.distinct + 1))
        log_n, log_share = np.log10(c.n + 0.5), np.log10(np.maximum(c.share, 0.5))
        for batch in batches:
            ids = batch.column("row_id"), batch.column("doc_id"), batch.column("held_out")
            for w in W.slices(batch.column("text"), fold=True):
                h, back, kind, place = _classes(w, c)
                first = w.first + np.arange(len(w.first))
                doc = np.repeat(np.arange(len(w.first) - 1), np.diff(first))
                total = lambda x: np.bincount(doc, x, len(w.first) - 1)
                known = place >= 0
                plain = np.where(known, log_n[place], 0.0) if len(c.n) else np.zeros(len(place))
                rest = kind >= c.top
                score = log_p[_contexts(w, kind), kind] + np.where(rest, plain - log_share[np.maximum(kind - c.top, 0)], 0.0)
                base = total(plain - base_mass)
                rare = np.flatnonzero(~known & (back >= 0))
                pair, n = np.unique(doc[rare] * len(h) + back[rare], return_counts=True) if len(rare) else (rare, rare)
                lists = np.searchsorted(pair, np.arange(len(w.first)) * max(len(h), 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(lists, pa.array(h[pair % max(len(h), 1)].view(np.int64) if len(h) else np.zeros(0, np.int64)))
                tail_n = pa.ListArray.from_arrays(lists, pa.array(n.astype(np.int32)))
                mine = [x.slice(w.rows.start, w.rows.stop - w.rows.start) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    mine + [pa.array(np.diff(first).astype(np.int64)), pa.array(total(known.astype(float)).astype(np.int64)), pa.array(base),
                            pa.array(total(score)), pa.array(total((~known).astype(float)).astype(np.int64)), tail, tail_n],
                    names=[x.split()[0] for x in _SCORED.split(", ")])
    return run


def score_texts(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of every whole text.

    Counts and model come from the rows where ``held_out`` is false (or null). Null text is empty: one end token. Repeated rows count as often as they
    occur. Without training rows all words are unknown. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = word_counts(train)
    corpus = Corpus(counts, head)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(corpus_arrays(corpus))
    pairs = train.mapInArrow(_pairs(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = context.broadcast(fit(pairs["pair"].to_numpy(), pairs["n"].to_numpy()))
    scored = store(rows.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_score(shared, table), _SCORED), "scored")
    tails = scored.select("row_id", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row_id", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("times"))
    met = tails.join(counts.where(~corpus.is_head).select("word", "n"), "word").groupBy("row_id").agg(
        F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("mass"))
    out = scored.drop("tail", "tail_n").join(met, "row_id", "left")
    found = F.coalesce("found", F.lit(0))
    rare = F.coalesce("mass", F.lit(0.0)) + (F.col("tail_tokens") - found) * F.lit(float(np.log10(0.5)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(int(corpus.tokens)).alias("train_tokens"),
                      (F.col("base") + rare).alias("base_score"), (F.col("score") + rare).alias("score"))


def corpus_arrays(corpus: Corpus) -> Corpus:
    """A copy without anything of the session, to send to tasks."""
    out = object.__new__(Corpus)
    out.__dict__ = {k: v for k, v in corpus.__dict__.items() if k != "is_head"}
    return out
