"""Exact top-k inner products by columnar branch and bound.

Vectors are compared in blocks: every block of queries meets every block of candidates in one task. A candidate block lies vertically
(a row per dimension, the heaviest dimensions first). For a query, products are accumulated dimension block by dimension block; the mass still
to come is bounded by the norms of the remaining dimensions of both sides, and candidates whose upper bound is below the
k-th best lower bound are compacted away. Each task hands on k rows for a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 8
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
_PAIR = "query_id long, vec_id long, score long"


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _rest(squares: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms of the dimensions from each cut on, a hair above the truth."""
    return [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the k best of the block for each query: greatest score first, ties by smaller id."""
    width = vertical.shape[0]
    as_float = [x.astype(np.float64) for x in (q, vertical)]
    weight = np.argsort(-(as_float[1] ** 2).sum(axis=1), kind="stable")
    largest = [float(np.abs(x).max(initial=0)) for x in as_float]
    exact = largest[0] * largest[1] * max(width, 1) < 2**52
    q, vertical = (q, vertical) if not exact else as_float
    q, vertical = np.ascontiguousarray(q[:, weight]), np.ascontiguousarray(vertical[weight])
    cuts = list(range(STEP, width, STEP)) + [width]
    rest_q = _rest((as_float[0][:, weight] ** 2).T, cuts)
    rest_v = _rest(as_float[1][weight] ** 2, cuts)
    out_q, out_v, out_s = [], [], []
    for begin in range(0, len(q), 64):
        head = q[begin:begin + 64, :cuts[0]] @ vertical[:cuts[0]]
        for j in range(len(head)):
            i = begin + j
            alive = np.flatnonzero(ids != q_ids[i])
            total = head[j][alive]
            for b, cut in enumerate(cuts):
                bound = rest_q[b][i] * rest_v[b][alive]
                slack = 0.5 + 1e-9 * abs(float(np.abs(total).max(initial=0)))
                if len(alive) > k:
                    least = np.partition(total - bound, len(alive) - k)[len(alive) - k]
                    stay = total + bound >= least - slack
                    alive, total = alive[stay], total[stay]
                if cut < width:
                    upto = cuts[b + 1]
                    total = total + q[i, cut:upto] @ vertical[cut:upto, alive]
            best = np.lexsort((ids[alive], -total))[:k]
            out_q.append(np.full(len(best), q_ids[i]))
            out_v.append(ids[alive][best])
            out_s.append(total[best].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _search(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(1, max(map(len, queries["vector"])), max(map(len, rows["vector"])))
        found = search_block(queries["vec_id"].to_numpy(), _matrix(queries["vector"], width), rows["vec_id"].to_numpy(),
                             np.ascontiguousarray(_matrix(rows["vector"], width).T), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))
    return run


def whole_vectors(table: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (array<long>): floor(scale * x) of every component; vectors null or with null or non-finite components drop out,
    and so do rows without an id."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return table.where(F.col(id_col).isNotNull() & x.isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query row with the rows of other ids.

    ``vectors`` has vec_id and vector (array<long>); shorter vectors count as filled up with zeros. A query whose id occurs in several rows
    is asked once, with one of them; candidates are all rows, so repeated rows of another id each take a rank. Ties go to the
    smaller id. Fewer than k candidates: all of them. Scores must fit 64 bits.
    """
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    part = lambda count: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = vectors.where(is_query).dropDuplicates(["vec_id"]).select(
        "vec_id", "vector", part(query_blocks).alias("query_block"), every(blocks).alias("block"))
    rows = vectors.select("vec_id", "vector", part(blocks).alias("block"), every(query_blocks).alias("query_block"))
    keys = ["block", "query_block"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_search(k), _PAIR)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
