"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of the hashed byte n-grams of its words (with their borders, A-Z folded); a linear layer
and a softmax give the language. Both are trained by stochastic gradient descent in numpy, on a sample whose bounds are parameters: up to PER_LANGUAGE
documents of up to SAMPLE_CHARS characters for each of the LANGUAGES most frequent labels; rarer labels are never predicted. A tenth of it is set
aside to fit the temperature of the softmax and, for each class of text lengths, the score below which a prediction is rejected: such that at most
REJECTED of the set-aside documents and of runs of their words miss it. Prediction covers whole texts: the linear layer is applied to every
embedding once, and each distinct word of a slice is summed once, a block of words at a time, so memory depends neither on the slice nor much on the number of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.tables import row_key

PER_LANGUAGE, SAMPLE_CHARS, LANGUAGES = 400, 20_000, 256
BUCKETS, WIDTH, EPOCHS, RATE = 1 << 15, 16, 3, 0.5
GRAMS = (1, 2, 3, 4)
#: Words of the runs that a training text gives.
RUNS = (1, 4, 12, 40, 120)
#: Lengths in words from which a class of texts has a threshold of its own, and runs of each length drawn from a set-aside text.
CLASSES, DRAWS = (0, 4, 12, 40), 8
REJECTED = 0.005
#: A prediction at least this probable is never rejected.
SURE = 0.75
WORD_BLOCK = 4096
UNKNOWN = "und"
OUT = ("lang_pred", "score", "rejected")
_LETTER = "__has_letter"


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, first n-gram of each word and the end). A word is taken with a space before and after it."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    space = data == 32
    word = np.cumsum(space) - 1
    found, owner = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        count = len(data) - n + 1
        h = np.full(count, n, np.uint64)
        inner = np.zeros(count, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k:k + count] + np.uint64(1)
            if 0 < k < n - 1:
                inner |= space[k:k + count]
        ok = ~inner if n > 1 else ~space[:count]
        if n == 2:
            ok &= ~(space[:count] & space[1:1 + count])
        at = np.flatnonzero(ok)
        found.append((W.mix(h[at]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(word[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """Languages, the logit of every n-gram bucket, bias, temperature and for each class of lengths the score below which predictions are rejected."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_scores: tuple[float, ...] = (0.0,) * len(CLASSES)

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        x = (mean_logits + self.bias) / self.temperature
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


    def word_logits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(summed logits, n-grams) of every word; block by block."""
        sums, sizes = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.int64)
        for i in range(0, len(words), WORD_BLOCK):
            grams, first = word_grams(words[i:i + WORD_BLOCK])
            sums[i:i + WORD_BLOCK] = np.add.reduceat(self.logits[grams], first[:-1], axis=0)
            sizes[i:i + WORD_BLOCK] = np.diff(first)
        return sums, sizes

    def rejects(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return score < np.array(self.least_scores)[np.searchsorted(CLASSES, n_words, "right") - 1]


def _examples(texts: list[str], labels: np.ndarray, rng, draws: int = 1, whole: bool = False) -> list[tuple[np.ndarray, int, int]]:
    """(n-gram buckets, label, words) of runs of the words of each text, and of the whole text."""
    out = []
    for text, label in zip(texts, labels):
        words = text.encode().split()
        if not words:
            continue
        grams, first = word_grams(words)
        for size in (*RUNS, *([len(words)] if whole else [])):
            for _ in range(draws if size < len(words) else 1):
                at = int(rng.integers(0, max(1, len(words) - size + 1)))
                end = min(at + size, len(words))
                out.append((grams[first[at]:first[end]].astype(np.int32), int(label), end - at))  # a copy, so the whole text's grams can go
    return [x for x in out if len(x[0])]


def _least(scores: list[np.ndarray]) -> tuple[float, ...]:
    """For each class, shortest first, the score that a further text of the kind misses with a probability of REJECTED at most; where there are too few to
    say, that of the class of shorter texts, which score lower."""
    out = [0.0]
    for s in scores:
        place = int(REJECTED * (len(s) + 1)) - 1
        out.append(min(float(np.sort(s)[place]), SURE) if place >= 0 else out[-1])
    return tuple(out[1:])


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """A model of the labelled texts; None without any."""
    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    labels = np.array([languages.index(x) for x in langs])
    order = rng.permutation(len(texts))
    n_kept = len(order) // 10 if len(order) >= 50 else 0
    pick = lambda part: ([texts[i] for i in part], labels[part], rng)
    chosen = _examples(*pick(order[n_kept:]))
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    total, step = EPOCHS * max(len(chosen), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(chosen)):
            grams, y, _ = chosen[i]
            rate = RATE * (1 - step / total)
            mean = emb[grams].mean(axis=0)
            x = mean @ out + bias
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y] -= 1.0
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            np.add.at(emb, grams, -(rate / len(grams)) * back * 4.0)
            step += 1
    model = Model(languages, (emb @ out).astype(np.float32), bias)
    aside = _examples(*pick(order[:n_kept]), DRAWS, True)
    if aside:
        logits = np.stack([model.logits[g].mean(axis=0) for g, _, _ in aside])
        y, n_words = np.array([y for _, y, _ in aside]), np.array([n for _, _, n in aside])
        tried = []
        for t in np.geomspace(0.1, 10, 41):
            model.temperature = float(t)
            tried.append((-np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean(), float(t)))
        model.temperature = min(tried)[1]
        best, of = model.probabilities(logits).max(axis=1), np.searchsorted(CLASSES, n_words, "right") - 1
        model.least_scores = _least([best[of == c] for c in range(len(CLASSES))])
    return model


def sample(docs: DataFrame, usable: Column) -> tuple[list[str], list[str]]:
    """Texts and labels for training: a bounded number of distinct rows per language, those with the least hash of id and text. Rows without id
    take part; repeated rows count once."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.select(*row_key(), "lang", "text")
    keys = rows.groupBy("lang", "key_high", "key_low").agg(F.lit(1).alias("one"))
    common = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key_high", "key_low"))
    keys = keys.join(F.broadcast(common), "lang").withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).select("lang", "key_high", "key_low")
    chosen = rows.join(F.broadcast(keys), ["lang", "key_high", "key_low"]).dropDuplicates(["lang", "key_high", "key_low"])  # at most PER_LANGUAGE * LANGUAGES
    got = sorted((r.lang, r.key_high, r.key_low, r.text) for r in chosen.collect())
    return [r[3] for r in got], [r[0] for r in got]


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for w in W.slices(batch.column("text")):
                n_docs = len(w.first) - 1
                n, sums = np.zeros(n_docs), np.zeros((n_docs, len(model.languages) if model else 1))
                if model and len(w.hash):
                    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
                    raw, doc = w.data.tobytes(), w.doc
                    per_word, size = model.word_logits([raw[w.start[i]:w.end[i]] for i in at])
                    n = np.bincount(doc, size[back], n_docs)
                    for k in range(len(model.languages)):
                        sums[:, k] = np.bincount(doc, per_word[:, k][back], n_docs)
                known = batch.column(_LETTER).slice(w.rows.start, n_docs).to_numpy(zero_copy_only=False) & (n > 0)
                if model:
                    p = model.probabilities(sums / np.maximum(n, 1)[:, None])
                    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), known)]
                    score = np.where(known, p.max(axis=1), 0.0)
                    rejected = ~known | model.rejects(score, w.counts)
                else:
                    names, score, rejected = [UNKNOWN] * n_docs, np.zeros(n_docs), np.ones(n_docs, bool)
                keep = [batch.column(i).slice(w.rows.start, n_docs) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(keep + [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                                                 names=[*batch.schema.names[:-1], *OUT])
    return run


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs``, text, lang_pred, score (0 to 1), rejected; the text alone decides.

    Text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned; those are rejected. Texts of any
    length are read whole. Repeated rows stay repeated, an empty table gives no rows. A kept column with the name of a result gives way to it; others
    may have any name."""
    columns = [c for c in dict.fromkeys((*keep, "text")) if c not in OUT]
    rows = docs.select(*columns, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(_LETTER))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), f"{types}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: a checksum of the id leaves remainder 1 by 3. Rows without id are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on the labelled rows that are not held out, predict all rows; see ``predict``."""
    model = train(*sample(docs, ~held_out()))
    return predict(docs, model, keep)
