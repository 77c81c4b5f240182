"""Hard negatives for contrastive training, with Four-Russians scoring.

Vectors are integers. A candidate is stored as bit planes: for every bit of its two's-complement components, one byte for each group of
eight dimensions. An anchor has one table for each group: the sums of all 256 subsets of its eight components. A score is then

    sum over bits of 2**bit * (sum over groups of table[group][byte])      (the highest bit counts negatively)

which is shifts, additions and lookups, and exact. Anchors and candidates meet in blocks:

1. Blocks of one label find the positives: the best rows with the anchor's own label. The block counts of a label follow its size, so a label with a
   third of all rows is many blocks.
2. All blocks find the negatives of every (anchor, positive): the best rows with another label whose score lies in the positive's band.

A task hands on the few best rows of its block; they are merged by rank. Nothing is sampled or cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.tables import store

GROUP = 8
#: Rows of a candidate block and of an anchor block; anchors whose tables are in use at a time.
CANDIDATE_BLOCK, ANCHOR_BLOCK, TABLES = 8192, 4096, 64
#: Components at or beyond 2**MOST_BITS are refused, so that 64 bits hold every sum of up to 2**13 dimensions.
MOST_BITS = 24


def bit_planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """uint8 (rows, bits * groups): the bytes of bit 0 of all groups, then of bit 1, and so on."""
    rows, width = vectors.shape
    padded = np.zeros((rows, -(-width // GROUP) * GROUP), np.int64)
    padded[:, :width] = vectors
    planes = [np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.concatenate(planes, axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """int64 (groups, 256, anchors): the sum of every subset of eight neighbouring components."""
    rows, width = anchors.shape
    groups = -(-width // GROUP)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :width] = anchors
    by_group = padded.reshape(rows, groups, GROUP).transpose(1, 2, 0)
    sums = np.zeros((groups, 1 << GROUP, rows), np.int64)
    for d in range(GROUP):
        sums[:, 1 << d:2 << d] = sums[:, :1 << d] + by_group[:, d:d + 1]
    small = np.abs(sums).max(initial=0) * max(groups, 1) < 2**31
    return sums.astype(np.int32) if small else sums


def scores(sums: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """int64 (candidates, anchors): exact inner products."""
    groups = sums.shape[0]
    planes = np.ascontiguousarray(planes.reshape(len(planes), bits, groups).transpose(1, 2, 0))
    total = np.zeros((planes.shape[2], sums.shape[2]), np.int64)
    for b in range(bits - 1, -1, -1):
        plane = np.take(sums[0], planes[b, 0], axis=0)
        for g in range(1, groups):
            plane += np.take(sums[g], planes[b, g], axis=0)
        total <<= 1
        total += -plane if b == bits - 1 else plane
    return total


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, the greatest first, ties by place."""
    if len(values) > k:
        at = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    else:
        at = np.arange(len(values))
    return at[np.argsort(-values[at], kind="stable")[:k]]


def _blocks(anchors: pd.DataFrame, rows: pd.DataFrame, bits: int, width: int):
    """(anchor rows, their scores (candidates, anchors)) for runs of TABLES anchors; candidates are in order of their id."""
    flat = np.zeros((len(anchors), width), np.int64)
    for i, v in enumerate(anchors["vector"]):
        flat[i, :len(v)] = v
    planes = np.frombuffer(b"".join(rows["planes"]), np.uint8).reshape(len(rows), -1)
    for begin in range(0, len(anchors), TABLES):
        part = slice(begin, begin + TABLES)
        yield anchors.iloc[part], scores(subset_sums(flat[part]), planes, bits)


def _positives(k: int, bits: int, width: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, out = rows["vec_id"].to_numpy(), []
        if len(anchors) and len(rows):
            for part, table in _blocks(anchors, rows, bits, width):
                for j, anchor in enumerate(part["vec_id"].to_numpy()):
                    other = np.flatnonzero(ids != anchor)
                    at = other[_best(table[other, j], k)]
                    out.append(pd.DataFrame({"anchor_id": anchor, "positive_id": ids[at], "positive_score": table[at, j]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "positive_id", "positive_score")})
    return run


def _negatives(k: int, low: int, high: int, bits: int, width: int):
    names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, labels, out = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), []
        if len(anchors) and len(rows):
            for part, table in _blocks(anchors, rows, bits, width):
                asked = zip(part["vec_id"], part["label"], part["positive_ids"], part["positive_scores"])
                for j, (anchor, label, positives, scored) in enumerate(asked):
                    other = np.flatnonzero((labels != label) & (ids != anchor))
                    own = table[other, j]
                    for place, (positive, score) in enumerate(zip(positives, scored)):
                        score = int(score)
                        near = np.flatnonzero((own <= score * high // 100) & (own >= -(-score * low // 100)))
                        at = near[_best(own[near], k)]
                        same = [np.full(len(at), x) for x in (anchor, place, positive, score)]
                        out.append((*same, ids[other[at]], own[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, columns)))
    return run


def _packed(bits: int, width: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            vectors = np.zeros((batch.num_rows, width), np.int64)
            vectors[np.repeat(np.arange(batch.num_rows), size), at] = lists.flatten().to_numpy(zero_copy_only=False)
            planes = pa.array([row.tobytes() for row in bit_planes(vectors, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), planes], names=["vec_id", "label", "planes"])
    return run


def scaled_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """vec_id, label, vector (array<long>): floor(scale * x) of every component. Rows without id, label or vector, or with a null or non-finite
    component, take no part; rows equal in all three count once. Further columns are not read."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    label = F.col(label) if isinstance(label, str) else label
    named = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(sound, whole).alias("vector"))
    return named.dropna(subset=["vec_id", "label", "vector"]).distinct()


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and vector (see ``scaled_vectors``); shorter vectors count as filled up with zeros. Scores are inner
    products with the anchor, greater ones first, ties by smaller vec_id. The positives of an anchor are the first ``positives`` rows of other ids with its label;
    for each, the first ``negatives`` rows of another label are returned with low * positive_score <= 100 * negative_score <= high *
    positive_score. Fewer than that: all of them; an anchor without positives, or a positive without negatives, has no row. An id that
    occurs with several labels or vectors is an anchor once, with the smallest of them, but each of its rows is a candidate. Empty tables give no rows. Components
    of 2**24 or more raise an error, as sums might leave 64 bits.
    """
    spark = vectors.sparkSession
    vectors = store(vectors.select("vec_id", "label", "vector"), "vectors")
    n, width, most, least = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    n_anchors = vectors.where(is_anchor).select("vec_id").distinct().count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, most, least = max(width, 1), max(most or 0, 0), min(least or 0, 0)
    if max(most, -least) >= 1 << MOST_BITS:
        raise ValueError(f"components lie between {least} and {most}; scale the vectors below 2**{MOST_BITS}")
    bits = 1 + max(most.bit_length(), (-least - 1).bit_length() if least else 0)
    rows = store(vectors.mapInArrow(_packed(bits, width), "vec_id long, label long, planes binary"), "planes")
    anchors = store(vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.*"), "anchors")

    part = lambda count, *key: F.pmod(F.xxhash64(*key), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    per_label = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).cast("int").alias("blocks"))
    per_label = per_label.join(anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).cast("int").alias("anchor_blocks")), "label")
    left = anchors.join(per_label, "label").select(
        "vec_id", "vector", "label", part(F.col("anchor_blocks"), "vec_id").alias("anchor_block"), every(F.col("blocks")).alias("block"))
    right = rows.join(per_label, "label").select(
        "vec_id", "planes", "label", part(F.col("blocks"), "vec_id", "planes").alias("block"), every(F.col("anchor_blocks")).alias("anchor_block"))
    keys = ["label", "block", "anchor_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _positives(positives, bits, width), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    asked = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # a few each
    asked = asked.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    asking = store(anchors.join(asked, "vec_id"), "asking")

    blocks, anchor_blocks = F.lit(-(-n // CANDIDATE_BLOCK)), F.lit(-(-n_anchors // ANCHOR_BLOCK))
    left = asking.select("vec_id", "vector", "label", "positive_ids", "positive_scores", part(anchor_blocks, "vec_id").alias("anchor_block"),
                         every(blocks).alias("block"))
    right = rows.select("vec_id", "planes", "label", part(blocks, "vec_id", "planes").alias("block"), every(anchor_blocks).alias("anchor_block"))
    keys = ["block", "anchor_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _negatives(negatives, low, high, bits, width),
        "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
