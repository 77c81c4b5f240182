"""Ranking metrics over scored rows without a global sort.

Rows are first reduced to one row per distinct score, as exact as it came; these are ranked by running totals over range
partitions, so no task sees them all. Rows with equal scores share a cut
in proportion, which is the expected value of breaking ties at random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.prefix import totals_before


def score_groups(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score: rows, positives, rows with a lower and with a higher score, and all positives. Stored. Rows without a score count as the lowest."""
    g = scored.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    ranked = totals_before(g, [F.col("score")], {"below": F.col("n")})
    rows, positives = ranked.agg(F.sum("n"), F.sum("pos")).first()
    all_of = lambda x: F.lit(x).cast("bigint")
    return ranked.select("score", "n", "pos", "below", all_of(rows).alias("rows"), all_of(positives).alias("positives"),
                         (all_of(rows) - F.col("below") - F.col("n")).alias("above"))


def auc(groups: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums; ties get their average rank."""
    mean_rank = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    s = groups.agg(F.sum(F.col("pos") * mean_rank).alias("r"), F.sum("pos").cast("double").alias("p"),
                   F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def top_metrics(groups: DataFrame, fractions: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """capture@k (share of positives in the top fraction), precision@k and the base rate."""
    g = groups.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    k = F.floor(F.col("rows") * F.col("fraction"))
    taken = F.greatest(F.least(F.col("n"), k - F.col("above")), F.lit(0))
    return g.groupBy("fraction").agg(
        F.sum(F.col("pos") * taken / F.col("n")).alias("_hits"), F.sum(taken).alias("n_top"),
        F.max("positives").alias("_p"), F.max("rows").alias("_r")).select(
        "fraction", "n_top", C.ratio("_hits", "_p").alias("capture"), C.ratio("_hits", "n_top").alias("precision"),
        C.ratio("_p", "_r").alias("base_rate")).orderBy("fraction")


def deciles(groups: DataFrame, buckets: int = 10) -> DataFrame:
    """Equal-count buckets by score (1 = lowest): mean prediction, actual rate, rows."""
    total = F.col("rows")
    lo, hi = F.col("below"), F.col("below") + F.col("n")
    first = F.floor(lo * buckets / total) + 1
    last = F.least(F.ceil(hi * buckets / total), F.lit(buckets))
    g = groups.withColumn("decile", F.explode(F.sequence(first, last)))
    edge = lambda b: F.floor(b * total / buckets)
    part = F.greatest(F.least(hi, edge(F.col("decile"))) - F.greatest(lo, edge(F.col("decile") - 1)), F.lit(0))
    g = g.withColumn("part", part).where(F.col("part") > 0)
    return g.groupBy("decile").agg(
        (F.sum(F.col("score") * F.col("part")) / F.sum("part")).alias("predicted"),
        (F.sum(F.col("pos") * F.col("part") / F.col("n")) / F.sum("part")).alias("actual"),
        F.sum("part").alias("tickets")).orderBy("decile")
