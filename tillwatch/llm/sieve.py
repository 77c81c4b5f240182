"""A bit table of fixed size that tells tasks which keys may belong to a set (a Bloom filter with two bits a key).

The table has BITS bits whatever the set, so it may be sent to every task. Beyond some fifty million keys it lets more strangers through; that
costs rows that travel in vain, never a result, as an exact join or count follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB, and two bits of a 64-bit hash for each key.
BITS = 1 << 27
_SECOND = 32


def sieve(keys: DataFrame, column: str) -> np.ndarray:
    """uint64 words of the bit table of a column of 64-bit hashes. The bits are merged on the executors; at most BITS / 64 words reach the driver."""
    bit = F.explode(F.array(F.col(column), F.shiftrightunsigned(column, _SECOND))).alias("h")
    place = keys.select(bit).select(F.col("h").bitwiseAND(F.lit(BITS - 1)).alias("p"))
    word = F.shiftright("p", 6).cast("int").alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    found = place.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which hashes (uint64 or int64) may be in the set; every member is."""
    values = values.view(np.uint64)
    held = np.ones(len(values), bool)
    for h in (values, values >> np.uint64(_SECOND)):
        p = h & np.uint64(BITS - 1)
        held &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return held
