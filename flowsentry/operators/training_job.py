"""The training job and its store: fit, choose a threshold, keep the model, record the run, promote; load and roll back.

A store is a folder with ``models/<run_id>`` (Parquet, a row for each tree node) and ``runs`` (JSON lines, append-only). Which model is active
follows from the run rows alone, so nothing is ever rewritten or copied.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry import schemas
from flowsentry.operators import boosting, cascade, models, training
from flowsentry.sources import readers, sinks


class Active(NamedTuple):
    run_id: str
    threshold: float
    model: boosting.Booster


def run_job(
    rows: DataFrame, key: list[str], store: str, run_id: str, timestamp: str, force: bool = False, **settings
) -> DataFrame:
    """Train on ``rows`` (features, label, from_feedback and ``key``), append the run and return its row.

    A run is promoted if its validation F1 reaches that of the active run, or with ``force``. ``report_*`` are the figures
    of the chosen threshold on the half of the validation rows it was not chosen on.
    """
    spark = rows.sparkSession
    split = training.stratified_split(rows, key)
    trained = models.train(split, **settings)
    trained.model.save(spark, f"{store}/models/{run_id}")
    scored = models.score_rows(split.where("is_val"), trained.model).select(
        "label", F.col("ml").alias("prob"), (F.pmod(F.xxhash64(*key), F.lit(2)) == 0).alias("_report")
    )
    best = models.pick_threshold(scored).first()
    half = models.pick_threshold(scored.where(~F.col("_report"))).first()["threshold"]
    alarm, attack = F.col("prob") >= half, F.col("label") == 1
    held = scored.where("_report").agg(F.count_if(alarm & attack), F.count_if(alarm), F.count_if(attack)).first()
    facts = training.attack_ratio(rows).first()
    current = active_event(spark, store)
    promoted = force or current is None or best["f1"] >= current["val_f1"]
    row = dict(
        run_id=run_id, timestamp=timestamp, kind="force" if force else "run", sampled_rows=facts["sampled_rows"],
        attack_ratio=facts["attack_ratio"], feedback_rows_used=facts["feedback_rows_used"], val_f1=best["f1"],
        val_precision=best["precision"], val_recall=best["recall"], recommended_threshold=best["threshold"],
        best_iteration=trained.best_iteration, best_score=trained.best_score, archived_model=f"models/{run_id}",
        promoted=bool(promoted), report_f1=2 * held[0] / max(1, held[1] + held[2]),
    )
    return _append(spark, store, row)


def roll_back(spark: SparkSession, store: str, run_id: str, timestamp: str) -> DataFrame:
    """Make an earlier run the active one again, by a row of its own."""
    found = runs(spark, store).where((F.col("run_id") == run_id) & (F.col("kind") != "rollback")).first()
    if found is None:
        raise ValueError(f"no run {run_id}")
    return _append(spark, store, {**found.asDict(), "timestamp": timestamp, "kind": "rollback", "promoted": True})


def _append(spark: SparkSession, store: str, row: dict) -> DataFrame:
    out = spark.createDataFrame([tuple(row.get(f.name) for f in schemas.RUN)], schemas.RUN)
    sinks.append_run(out, f"{store}/runs")
    return out


def runs(spark: SparkSession, store: str) -> DataFrame:
    return readers.read_runs(spark, f"{store}/runs")


def run_events(spark: SparkSession, store: str) -> DataFrame:
    """Run rows in the layout of ``models.promotions``: one registry, in order of time."""
    seq = F.row_number().over(Window.orderBy("timestamp", "run_id"))  # one row per training run or rollback
    rows = runs(spark, store).withColumn("kind", F.coalesce("kind", F.lit("run")))
    return rows.select(F.lit(store).alias("registry"), seq.cast("long").alias("seq"), "run_id", "val_f1", "kind", "recommended_threshold")


def active_event(spark: SparkSession, store: str):
    """The promoted event that counts now, or None."""
    decided = models.promotions(run_events(spark, store)).where("promoted")
    return decided.orderBy(F.desc("seq")).first()


def load_active(spark: SparkSession, store: str) -> Active | None:
    event = active_event(spark, store)
    if event is None:
        return None
    model = boosting.Booster.load(spark, f"{store}/models/{event['run_id']}", schemas.MODEL_FEATURES)
    return Active(event["run_id"], event["recommended_threshold"], model)


def cascade_config(spark: SparkSession, store: str, **settings) -> cascade.CascadeConfig:
    """Settings of a cascade that scores with the active model; with the heuristic if none was ever promoted."""
    active = load_active(spark, store)
    if active is None:
        return cascade.CascadeConfig(**settings)
    return cascade.CascadeConfig(threshold=active.threshold, scorer=models.model_scorer(active.model), **settings)
