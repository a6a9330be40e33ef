"""Model training, scoring, threshold choice, metrics and run history."""

from __future__ import annotations

from typing import Callable, NamedTuple

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.operators import boosting
from flowsentry.schemas import MODEL_FEATURES
from flowsentry.session import materialize

# The candidate thresholds; ticks are sums of steps, not exact decimals.
THRESHOLDS = [float(t) for t in np.arange(0.20, 0.96, 0.01)]

class Trained(NamedTuple):
    """A model cut after its best round, that round, and its log loss per validation row."""

    model: boosting.Booster
    best_iteration: int
    best_score: float


def train(rows: DataFrame, rounds: int = 350, patience: int = 25, seed: int = 42, **settings) -> Trained:
    """Second-order boosted trees on rows with ``label`` and ``is_val``, up to the round that validates best.

    Boosting ends when ``patience`` rounds have brought no better validation loss. ``settings`` are those of
    ``boosting.Settings``.
    """
    found = boosting.fit(rows, MODEL_FEATURES, rounds, patience, seed, **settings)
    return Trained(found.model, found.best_iteration, found.best_score)


def train_model(rows: DataFrame, rounds: int = 350, seed: int = 42, **settings) -> boosting.Booster:
    return train(rows, rounds, seed=seed, **settings).model


def score_rows(rows: DataFrame, model: boosting.Booster) -> DataFrame:
    """Add ``ml``, the attack probability."""
    return rows.withColumn("ml", model.probability())


def model_scorer(model: boosting.Booster) -> Callable[[DataFrame], DataFrame]:
    """Scorer for the detection cascade."""
    return lambda features: score_rows(features, model)


def score_events(features: DataFrame, threshold: float, model: boosting.Booster | None = None) -> DataFrame:
    """Score and label per feature row; the heuristic stands in when there is no model."""
    if model is not None:
        scored = score_rows(features, model)
    else:
        score = L.heuristic_score(F.col("dst_port"), F.col("total_bytes"), F.col("flags_mask"), F.col("protocol"))
        scored = features.withColumn("ml", score)
    return scored.withColumn("ml_label", L.anomaly_label(F.col("ml"), threshold))


def thresholds_reached(prob: Column) -> Column:
    """Number of candidate thresholds not above ``prob``: a first guess, corrected against the exact ticks."""
    ticks = F.array(*[F.lit(t) for t in THRESHOLDS])
    last = len(THRESHOLDS)
    guess = F.least(F.greatest(F.floor((prob - THRESHOLDS[0]) / 0.01).cast("int") + 1, F.lit(0)), F.lit(last))
    above = F.when((guess < last) & (prob >= F.get(ticks, guess)), 1).otherwise(0)
    below = F.when((guess > 0) & (prob < F.get(ticks, guess - 1)), 1).otherwise(0)
    return guess + above - below


def confusion_by_threshold(scores: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (label, prob) rows at every candidate threshold, in one pass.

    Scores are reduced to a histogram of at most 77 rows; everything after that runs on the histogram.
    """
    histogram = scores.groupBy(thresholds_reached(F.col("prob")).alias("step")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ticks = [F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)]
    ticks.append(F.struct(F.lit(0).alias("step"), F.lit(None).cast("double").alias("threshold")))
    steps = scores.sparkSession.range(1).select(F.inline(F.array(*ticks)))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = (
        steps.join(histogram, "step", "left")
        .withColumns(
            {
                "tp": F.sum(F.coalesce("pos", F.lit(0))).over(above),
                "fp": F.sum(F.coalesce("neg", F.lit(0))).over(above),
                "_pos": F.sum(F.coalesce("pos", F.lit(0))).over(everything),
            }
        )
        .where(F.col("threshold").isNotNull())
        .withColumn("fn", F.col("_pos") - F.col("tp"))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    return counted.withColumns(
        {"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    ).select("threshold", "tp", "fp", "fn", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"))


def pick_threshold(scores: DataFrame) -> DataFrame:
    """The threshold with the best F1; the lowest one wins a tie."""
    best = F.min_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(-F.col("f1"), "threshold"))
    return confusion_by_threshold(scores).agg(best.alias("best")).select("best.*")


def eval_metrics(scores: DataFrame) -> DataFrame:
    """Area under the ROC and precision-recall curves and log loss of (label, prob) rows."""
    scores = materialize(scores.select("label", "prob"), "scores")  # read by three passes
    prob = F.col("prob").cast("double")
    rows = scores.select(
        F.col("label").cast("double"), array_to_vector(F.array(1 - prob, prob)).alias("rawPrediction")
    )
    area = lambda metric: BinaryClassificationEvaluator(metricName=metric, numBins=0).evaluate(rows)
    p = F.least(F.greatest(prob, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return scores.agg(F.avg(loss).alias("logloss")).select(
        F.lit(area("areaUnderROC")).alias("auc"), F.lit(area("areaUnderPR")).alias("aucpr"), "logloss"
    )


def promotions(events: DataFrame) -> DataFrame:
    """Run events with ``active_f1_before`` and ``promoted``.

    Events are (registry, seq, run_id, val_f1, kind): ``run`` is promoted if its F1 reaches the active one's,
    ``force`` always, ``rollback`` re-activates ``run_id`` (val_f1 is that run's). Between forced changes the
    active F1 never falls, so it is the running maximum since the last of them.
    """
    by_seq = Window.partitionBy("registry").orderBy("seq")
    reset = (F.col("kind") != "run").cast("int")
    marked = events.withColumn("_since", F.sum(reset).over(by_seq))
    upto = Window.partitionBy("registry", "_since").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active_after = marked.withColumn("_active_after", F.max("val_f1").over(upto))
    before = F.coalesce(F.lag("_active_after").over(by_seq), F.lit(-1.0))
    return (
        active_after.withColumn("active_f1_before", before)
        .withColumn("promoted", (F.col("kind") != "run") | (F.col("val_f1") >= F.col("active_f1_before")))
        .drop("_since", "_active_after")
    )


def active_run(events: DataFrame) -> DataFrame:
    """Current run, its F1 and the best F1 of every registry."""
    decided = promotions(events)
    current = F.when(F.col("promoted"), F.struct("run_id", "val_f1"))
    return (
        decided.groupBy("registry")
        .agg(
            F.max_by(current, F.when(F.col("promoted"), F.col("seq"))).alias("_current"),
            F.max("val_f1").alias("best_val_f1"),
        )
        .select("registry", F.col("_current.run_id").alias("current_run_id"), F.col("_current.val_f1").alias("current_f1"), "best_val_f1")
    )


def run_deltas(runs: DataFrame) -> DataFrame:
    """Latest minus first run of a registry, in percentage points; registries with one run are left out."""
    body = F.struct("val_f1", "val_precision", "val_recall")
    ends = runs.groupBy("registry").agg(
        F.count(F.lit(1)).alias("runs"), F.min_by(body, "seq").alias("first"), F.max_by(body, "seq").alias("latest")
    )
    delta = lambda c: ((F.col(f"latest.val_{c}") - F.col(f"first.val_{c}")) * 100).alias(f"{c}_delta")
    return ends.where(F.col("runs") > 1).select("registry", "runs", delta("f1"), delta("precision"), delta("recall"))
