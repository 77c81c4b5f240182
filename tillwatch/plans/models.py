"""Boosted-tree models for payment failure and repurchase."""

from __future__ import annotations

import hashlib
import logging

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.tables import union_on
from tillwatch.operators import features, marketing, ranking
from tillwatch.session import shared_home, write_shared

MIN_POSITIVES = 200
log = logging.getLogger(__name__)


def train(rows: DataFrame, categorical: list[str], numeric: list[str], label: str, trees: int = 20, depth: int = 5,
          seed: int = 42) -> PipelineModel:
    """Index categories, assemble and boost; trees are grown on binned features aggregated across tasks."""
    indexed = [f"{c}_ix" for c in categorical]
    filled = _fill(rows, numeric).withColumn(label, F.col(label).cast("double"))
    stages, values = [], 0
    if categorical:
        stages = [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep").fit(filled)]
        values = max(map(len, stages[0].labelsArray))
    stages += [VectorAssembler(inputCols=indexed + numeric, outputCol="features"),
               GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed,
                             maxBins=max(64, values + 1), checkpointInterval=10)]  # a category needs a bin for each of its values
    return Pipeline(stages=stages).fit(filled)


def fitted(rows: DataFrame, categorical: list[str], numeric: list[str], label: str, name: str, **options) -> PipelineModel:
    """The stored model ``name`` of exactly these training rows and options; fitted and stored where there is none yet.

    Its version is a digest of the rows, so a model is fitted once and read by every report of the same data, in this session or a later one.
    A model that was not written to its end is fitted again.
    """
    columns = [*categorical, *numeric, label]
    n, mark = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    about = hashlib.sha256(repr((n, mark, columns, sorted(options.items()))).encode()).hexdigest()[:24]
    path = f"{shared_home(rows.sparkSession, 'models')}/{name}-{about}"
    try:
        return PipelineModel.load(path)
    except Exception as missing:  # the reader's error depends on the file system
        log.info("no model at %s (%s)", path, type(missing).__name__)
    train(rows, categorical, numeric, label, **options).write().overwrite().save(path)
    return PipelineModel.load(path)


def _fill(rows: DataFrame, numeric: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numeric})


def score(model: PipelineModel, rows: DataFrame, numeric: list[str], keep: list[str]) -> DataFrame:
    out = model.transform(_fill(rows, numeric))
    return out.select(*keep, vector_to_array("probability")[1].alias("score"))


def failure_scores(tickets: DataFrame, split: Column, everything: bool = False) -> tuple[PipelineModel, DataFrame]:
    """Model trained on attempts before ``split``; scores of the later ones (or of all).

    The features are written once: boosting reads them many times.
    """
    f = write_shared(features.build_features(tickets), "features")
    train_rows, test_rows = features.time_split(f, split)
    model = fitted(train_rows, features.CATEGORICAL, features.NUMERIC, "is_failed", "failure")
    keep = ["ticket_id", "customer_id", "time", "is_failed"]
    return model, score(model, f if everything else test_rows, features.NUMERIC, keep)


def feature_importance(model: PipelineModel, categorical: list[str], numeric: list[str], like: DataFrame) -> DataFrame:
    """Importance of each feature (one small vector of the model), largest first."""
    names = categorical + numeric
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in zip(names, values)])
    return like.sparkSession.range(1).select(F.inline(rows)).orderBy(F.desc("importance"), "feature")


def target_list(tickets: DataFrame, cut: Column, n_cuts: int = 3) -> DataFrame:
    """Customers at ``cut`` with segment, action and repurchase score, best first.

    The model only sees cuts whose 90-day label lies before ``cut``. With fewer than 200 positives the score is the
    recency rule.
    """
    cuts = marketing.training_cuts(cut, n_cuts)
    training = write_shared(marketing.features_at(tickets, cuts, marketing.HORIZON_DAYS), "training")
    now = marketing.with_segment(marketing.customer_features(tickets, cut))
    positives = training.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()["p"]
    if positives >= MIN_POSITIVES:
        numeric = marketing.FEATURES
        model = fitted(training, [], numeric, "y", "repurchase")
        scored = model.transform(now.withColumns({f"_{c}": F.col(c) for c in numeric}).transform(_fill, numeric)).select(
            "customer_id", "segment", "action", *[F.col(f"_{c}").alias(c) for c in ("recency_days", "frequency", "monetary", "promo_share")],
            vector_to_array("probability")[1].alias("score"), F.lit("model").alias("score_source"))
    else:
        scored = now.select("customer_id", "segment", "action", "recency_days", "frequency", "monetary", "promo_share",
                            marketing.recency_score().alias("score"), F.lit("rule: recency").alias("score_source"))
    return scored.withColumns({c: F.round(c, 4) for c in ("score", "monetary", "promo_share")})


def best_targets(targets: DataFrame, n: int = 5000) -> DataFrame:
    return targets.orderBy(F.desc("score"), "customer_id").limit(n)


def repurchase_scores(tickets: DataFrame, end: Column, n_cuts: int = 3) -> DataFrame | None:
    """customer_id, y, recency_days, score at the last cut whose label is known: the model sees only cuts whose labels end before it. None with fewer
    than 200 positives to learn from."""
    cut = C.plus_days(end, -marketing.HORIZON_DAYS)
    training = write_shared(marketing.features_at(tickets, marketing.training_cuts(cut, n_cuts), marketing.HORIZON_DAYS), "training")
    if training.agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0] < MIN_POSITIVES:
        return None
    test = marketing.features_at(tickets, [cut], marketing.HORIZON_DAYS)
    raw = test.withColumn("_recency", F.col("recency_days"))
    out = score(fitted(training, [], marketing.FEATURES, "y", "repurchase"), raw, marketing.FEATURES, ["customer_id", "y", "_recency"])
    return write_shared(out.withColumnRenamed("_recency", "recency_days"), "repurchase-scores")


def repurchase_metrics(tickets: DataFrame, end: Column, fraction: float = 0.2) -> DataFrame:
    """One row each for the model (where there is enough to learn from) and the recency rule: auc, precision and capture of the best ``fraction``, base rate."""
    scored = repurchase_scores(tickets, end)
    cut = C.plus_days(end, -marketing.HORIZON_DAYS)
    rows = marketing.features_at(tickets, [cut], marketing.HORIZON_DAYS) if scored is None else scored
    named = {"rule: recency": rows.withColumn("score", -F.col("recency_days").cast("double"))} | ({} if scored is None else {"model": scored})
    out = []
    for name, df in named.items():
        groups = ranking.score_groups(df, "score", "y")
        out.append(ranking.top_metrics(groups, (fraction,)).crossJoin(ranking.auc(groups)).select(F.lit(name).alias("score_source"), "*"))  # one row each
    return union_on(out, "score_source")
