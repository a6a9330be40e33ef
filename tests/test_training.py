import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowsentry.operators import boosting, flows, models, training, training_job
from flowsentry.plans import inputs as I
from flowsentry.plans import learning
from flowsentry.sources import readers, sinks
from tests.conftest import SF_SMALL


def test_targets_follow_the_ratio_and_the_last_file_takes_the_rest(spark):
    def targets(rows, most):
        counts = spark.createDataFrame(rows, "source_file string, benign long, attack long")
        return sorted(map(tuple, training.allocate_targets(counts, 0.9, 0.1, most).collect()))

    assert targets([("b", 300, 25), ("a", 700, 50)], 10_000) == [("a", 472, 50), ("b", 203, 25)]
    assert targets([("a", 700, 50), ("b", 300, 25)], 100) == [("a", 63, 7), ("b", 27, 3)]
    with pytest.raises(ValueError):
        targets([("a", 700, 0)], 100)


def test_samples_are_exact_and_repeatable(spark):
    rows = spark.range(3_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    targets = spark.createDataFrame([(0, 777), (1, 5_000)], "label int, n long")
    pick = lambda seed: {r["id"] for r in training.stratified_sample(rows, ["label"], targets, ["id"], seed).collect()}
    first = pick(1)
    assert len([i for i in first if i % 10]) == 777 and len([i for i in first if i % 10 == 0]) == 300
    assert first == pick(1) != pick(2)


def test_equal_rows_are_spread_by_their_row_number(spark):
    rows = spark.range(2_000).select(F.lit("same").alias("x"), F.col("id").alias("row_no"), F.lit(0).alias("label"))
    targets = spark.createDataFrame([(0, 100)], "label int, n long")
    assert training.stratified_sample(rows, ["label"], targets, ["x", "row_no"], 1).count() == 100
    # Without one they fall into one bucket, and the sample is still exact.
    assert training.stratified_sample(rows, ["label"], targets, ["x"], 1).count() == 100


def test_candidates_hold_the_lowest_hashes(spark):
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("f"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    sizes = rows.groupBy("f", "label").agg(F.count("*").alias("size")).withColumn("n", F.least(F.lit(40), F.col("size")).cast("long"))
    found = training.lowest_hashes(rows, ["f", "label"], sizes, ["id"], 7)
    assert 160 <= found.count() < 4 * (40 + 8 * 40**0.5 + 32) * 1.5
    cut = lambda df: sorted(map(tuple, training.stratified_sample(df, ["f", "label"], sizes.drop("size"), ["id"], 7).collect()))
    assert cut(found) == cut(rows) and len(cut(found)) == 160
    # A third of the rows is one row: one hash holds them all, wherever it lies.
    clumped = rows.withColumn("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    for seed in (1,):
        got = training.stratified_sample(training.lowest_hashes(clumped, ["label"], spark.createDataFrame(
            [(0, 17_142, 12_000), (1, 2_858, 2_858)], "label int, size long, n long"), ["id"], seed), ["label"],
            spark.createDataFrame([(0, 12_000), (1, 2_858)], "label int, n long"), ["id"], seed)
        assert got.count() == 14_858


def test_attack_ratio_is_that_of_all_rows_the_class_ratio_allows(spark, tmp_path, monkeypatch):
    n = F.col("id")
    lines = spark.range(30_000).select(
        n.alias("l_orderkey"), (3 * n).alias("l_partkey"), (n % 7).alias("l_linenumber"), n.alias("l_suppkey"),
        F.when(n % 4 == 0, "O").otherwise("F").alias("l_linestatus"), F.when(n % 10 == 0, "R").otherwise("N").alias("l_returnflag"),
        (n % 50).cast("double").alias("l_quantity"), (n * 1.5).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    features = F.create_map(F.lit("duration"), F.lit("1"))
    feedback = spark.range(0, 100_002, 1, 4).select(
        n.cast("string").alias("alert_id"), F.lit("resolved").alias("decision"), F.lit("t").alias("decision_timestamp"),
        F.struct(features.alias("model_features")).alias("alert"))
    monkeypatch.setattr(learning, "written_feedback", lambda spark, sf: feedback)
    got = entry.queries()["agg14_attack_ratio"](spark, str(tmp_path)).first()
    assert (got["sampled_rows"], got["feedback_rows_used"]) == (130_002, 100_002)
    assert got["attack_ratio"] == round((3_000 + 100_002) / 130_002, 6)


def test_split_takes_a_fifth_of_each_class(spark):
    rows = spark.range(109).select("id", (F.col("id") < 9).cast("int").alias("label"))
    got = training.stratified_split(rows, ["id"]).groupBy("label", "is_val").count().collect()
    assert {(r["label"], r["is_val"]): r["count"] for r in got} == {(0, True): 20, (0, False): 80, (1, True): 1, (1, False): 8}


def best_threshold(scores):
    """From the sorted scores: F1 is 2 tp over the number of alarms plus the number of attacks."""
    attacks = sum(y for y, _ in scores)
    ordered = sorted(p for _, p in scores)
    hits = sorted(p for y, p in scores if y)
    found = []
    for t in np.arange(0.20, 0.96, 0.01):
        alarms = len(ordered) - bisect.bisect_left(ordered, t)
        tp = len(hits) - bisect.bisect_left(hits, t)
        found.append((2 * tp / max(1, alarms + attacks), -t, tp / max(1, alarms), tp / max(1, attacks)))
    f1, t, precision, recall = max(found)
    return float(-t), f1, precision, recall


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_equals_sorted_counts(spark, seed):
    rnd = np.random.default_rng(seed)
    ticks = np.arange(0.20, 0.96, 0.01)
    probs = np.concatenate([rnd.random(200), ticks, np.nextafter(ticks, 0), [0.35, 0.0, 1.0]])
    scores = [(int(rnd.random() < p), float(p)) for p in probs]
    got = models.pick_threshold(spark.createDataFrame(scores, "label int, prob double")).first()
    assert tuple(got) == pytest.approx(best_threshold(scores), abs=1e-12)


def test_threshold_without_attacks(spark):
    got = models.pick_threshold(spark.createDataFrame([(0, 0.9)], "label int, prob double")).first()
    assert tuple(got) == (models.THRESHOLDS[0], 0.0, 0.0, 0.0)


def test_promotion_and_rollback(spark):
    events = [("m", 1, "a", 0.90, "run"), ("m", 2, "b", 0.80, "run"), ("m", 3, "c", 0.95, "run"), ("m", 4, "a", 0.90, "rollback"),
              ("m", 5, "d", 0.92, "run"), ("m", 6, "e", 0.92, "run"), ("m", 7, "f", 0.10, "run"), ("n", 1, "x", 0.5, "run"),
              ("n", 2, "y", 0.4, "force"), ("n", 3, "z", 0.45, "run")]
    df = spark.createDataFrame(events, "registry string, seq long, run_id string, val_f1 double, kind string")
    got = {(r["registry"], r["seq"]): (r["promoted"], r["active_f1_before"]) for r in models.promotions(df).collect()}
    assert got == {("m", 1): (True, -1.0), ("m", 2): (False, 0.9), ("m", 3): (True, 0.9), ("m", 4): (True, 0.95),
                   ("m", 5): (True, 0.9), ("m", 6): (True, 0.92), ("m", 7): (False, 0.92), ("n", 1): (True, -1.0),
                   ("n", 2): (True, 0.5), ("n", 3): (True, 0.4)}
    current = {r["registry"]: (r["current_run_id"], r["current_f1"], r["best_val_f1"]) for r in models.active_run(df).collect()}
    assert current == {"m": ("e", 0.92, 0.95), "n": ("z", 0.45, 0.5)}


def test_runs_are_appended(spark, tmp_path):
    run = spark.createDataFrame([("r1", 0.9)], "run_id string, val_f1 double")
    sinks.append_run(run, str(tmp_path / "runs"))
    sinks.append_run(run.withColumn("run_id", F.lit("r2")), str(tmp_path / "runs"))
    assert sorted(r["run_id"] for r in readers.read_runs(spark, str(tmp_path / "runs")).collect()) == ["r1", "r2"]


def test_model_separates_what_can_be_separated(spark):
    rows = spark.range(600).select(
        "id", *[(F.col("id") % 7 + i).cast("float").alias(f) for i, f in enumerate(models.MODEL_FEATURES[:-1])],
        F.when(F.col("id") % 3 == 0, 6.0).otherwise(17.0).cast("float").alias("protocol"),
        (F.col("id") % 3 == 0).cast("int").alias("label"))
    trained = models.train(training.stratified_split(rows, ["id"]), rounds=4, patience=1, max_depth=2, column_share=1.0, step=0.5)
    model = trained.model
    assert len(model.trees) == trained.best_iteration + 1 and 0 < trained.best_score < 0.6
    scored = models.score_rows(rows, model)
    best = models.pick_threshold(scored.select("label", F.col("ml").alias("prob"))).first()
    assert best["f1"] == 1.0
    features = flows.flow_features(I.packets(spark, SF_SMALL))
    labels = models.score_events(features, 0.5, model).groupBy("proto", "ml_label").count().collect()
    assert {r["ml_label"] for r in labels if r["proto"] == "TCP"} == {"xgboost_anomaly"}


def test_job_promotes_and_rolls_back(spark, tmp_path):
    store = str(tmp_path / "store")
    noise = F.pmod(F.xxhash64("id"), F.lit(10)) < 3
    rows = spark.range(400).select(
        "id", *[(F.col("id") % 7 + i).cast("float").alias(f) for i, f in enumerate(models.MODEL_FEATURES[:-1])],
        F.when(F.col("id") % 3 == 0, 6.0).otherwise(17.0).cast("float").alias("protocol"),
        (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(False).alias("from_feedback"))
    worse = rows.withColumn("label", F.when(noise, 1 - F.col("label")).otherwise(F.col("label")))
    small = dict(rounds=2, patience=1, max_depth=2, column_share=1.0)
    assert training_job.load_active(spark, store) is None
    assert training_job.cascade_config(spark, store).scorer is None
    first = training_job.run_job(worse, ["id"], store, "a", "2026-01-01T00:00:00Z", **small).first()
    second = training_job.run_job(rows, ["id"], store, "b", "2026-01-02T00:00:00Z", **small).first()
    third = training_job.run_job(worse, ["id"], store, "c", "2026-01-03T00:00:00Z", **small).first()
    assert (first["promoted"], second["promoted"], third["promoted"]) == (True, True, False)
    assert second["val_f1"] == 1.0 > first["val_f1"] and second["sampled_rows"] == 400 and 0 <= first["report_f1"] <= 1
    assert training_job.load_active(spark, store).run_id == "b"
    features = flows.flow_features(I.packets(spark, SF_SMALL))
    with_b = training_job.cascade_config(spark, store).scorer(features).agg(F.sum("ml")).first()[0]
    training_job.roll_back(spark, store, "a", "2026-01-04T00:00:00Z")
    assert training_job.load_active(spark, store).run_id == "a"
    assert training_job.cascade_config(spark, store).scorer(features).agg(F.sum("ml")).first()[0] != with_b
    with pytest.raises(ValueError):
        training_job.roll_back(spark, store, "nothing", "2026-01-05T00:00:00Z")


def grown(x, y, p, depth, l2, least):
    """(margin change of each row) by the textbook: every cut of every feature tried on the rows themselves."""
    g, h = p - y, p * (1 - p)
    out = np.full(len(y), -g.sum() / (h.sum() + l2))
    if depth == 0:
        return out
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    found = []
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= least:
                found.append((score(left) + score(~left) - score(left | True), left))
    if not found or max(found, key=lambda t: t[0])[0] <= 1e-9:
        return out
    left = max(found, key=lambda t: t[0])[1]
    for m in (left, ~left):
        out[m] = grown(x[m], y[m], p[m], depth - 1, l2, least)
    return out


def boosting_rows(spark, n=500):
    rnd = np.random.default_rng(5)
    x = np.round(rnd.random((n, 3)) * 40).astype(np.float32)
    y = ((x[:, 0] > 17) ^ (x[:, 1] * 2 > x[:, 2]) ^ (rnd.random(n) < 0.05)).astype(int)
    rows = [(*map(float, a), int(b), i % 5 == 0) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, np.arange(n) % 5 == 0, spark.createDataFrame(rows, "a float, b float, c float, label int, is_val boolean")


def test_boosting_equals_exhaustive_growth(spark):
    x, y, held, df = boosting_rows(spark)
    plain = dict(row_share=1.0, column_share=1.0, max_depth=3, step=0.3)
    fitted = boosting.fit(df, ["a", "b", "c"], rounds=4, patience=9, **plain)
    margin, losses = np.full(len(y), np.log(y[~held].mean() / (1 - y[~held].mean()))), []
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        change = grown(x[~held], y[~held], p[~held], 3, 1.0, 3.0)
        margin[~held] += 0.3 * change
    ours = 1 / (1 + np.exp(-fitted.model.margin(x)))
    assert np.allclose(ours[~held], 1 / (1 + np.exp(-margin[~held])), atol=1e-6)
    assert fitted.best_iteration == 3 and all(a > b for a, b in zip(fitted.losses, fitted.losses[1:]))
    q = np.where(y == 1, ours, 1 - ours)[held]
    assert fitted.best_score == pytest.approx(-np.log(q).mean(), abs=1e-6)
    again = boosting.fit(df.repartition(5), ["a", "b", "c"], rounds=4, patience=9, **plain)
    assert again.losses == fitted.losses


def test_boosting_stops_stores_and_takes_missing_values(spark, tmp_path):
    x, y, held, df = boosting_rows(spark)
    noise = df.withColumn("label", (F.pmod(F.xxhash64("a", "b", "c"), F.lit(2)) == 0).cast("int"))
    fitted = boosting.fit(noise, ["a", "b", "c"], rounds=60, patience=2, step=0.5)
    assert len(fitted.losses) == fitted.best_iteration + 3 < 60 and len(fitted.model.trees) == fitted.best_iteration + 1
    # Margins written anew on the way change nothing.
    fitted = boosting.fit(df, ["a", "b", "c"], rounds=12, patience=30)
    scored = df.select("*", fitted.model.probability().alias("p")).where("is_val")
    loss = -F.when(F.col("label") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))
    assert scored.agg(F.avg(loss)).first()[0] == pytest.approx(fitted.best_score, abs=1e-6)
    fitted.model.save(spark, str(tmp_path / "m"))
    stored = boosting.Booster.load(spark, str(tmp_path / "m"), ["a", "b", "c"])
    assert np.array_equal(stored.margin(x), fitted.model.margin(x))
    odd = spark.createDataFrame([(None, 1.0, 2.0), (float("nan"), 1.0, 2.0), (-1e30, 1.0, 2.0)], "a double, b double, c double")
    assert len({r["p"] for r in odd.select(stored.probability().alias("p")).collect()}) == 1
    with_gaps = df.withColumn("a", F.when(F.col("a") > 5, F.col("a")))
    assert 0 < boosting.fit(with_gaps, ["a", "b", "c"], rounds=2).best_score < 0.7
    with pytest.raises(ValueError):
        boosting.fit(df.where("label = 1"), ["a", "b", "c"], rounds=2)
    # No validation rows: all rounds count.
    assert boosting.fit(df.withColumn("is_val", F.lit(False)), ["a", "b", "c"], rounds=2).best_iteration == 1
