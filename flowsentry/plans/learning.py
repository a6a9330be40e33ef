"""Catalogue queries over training data, feedback, thresholds, models and runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions import scalars as S
from flowsentry.operators import decisions, flows, models, training, training_job
from flowsentry.plans import inputs as I
from flowsentry.plans import oracle as O
from flowsentry.plans.alert_views import DECIDED_SQL, decided
from flowsentry.plans.catalog import Catalog
from flowsentry.schemas import FLOW_CSV_COLUMNS, MODEL_FEATURES
from flowsentry.session import materialize, scratch_path
from flowsentry.plans.stores import written_lines
from flowsentry.sources import readers, sinks

FLOWS_SQL = """flows as (select l_orderkey, l_partkey, l_linenumber, l_linestatus as source_file,
  case when l_linenumber % 2 = 0 then 6.0::double else 17.0::double end as protocol, floor(l_extendedprice) as in_bytes,
  case when l_partkey % 50 = 0 then 0 else floor(l_quantity) end as in_pkts, floor(l_extendedprice * l_discount) as out_bytes,
  floor(l_quantity / 4) as out_pkts, greatest(cast(l_suppkey % 500 * 10 as double), 1) / 1000.0::double as duration,
  case when l_returnflag = 'R' and l_partkey % 3 = 0 then 1 else 0 end as label from lineitem),
counts as (select source_file, count(*) filter (label = 0) as benign, count(*) filter (label = 1) as attack from flows group by 1),
total as (select *, cast(floor(size * 0.9::double) as bigint) as want_benign from (select sum(benign) as benign, sum(attack) as attack,
  floor(least(20000, sum(benign) / 0.9::double, sum(attack) / 0.1::double)) as size from counts)),
ordered as (select c.*, row_number() over (order by source_file) as place, count(*) over () as files,
  round_even(want_benign * (c.benign / t.benign), 0) as b, round_even((size - want_benign) * (c.attack / t.attack), 0) as a,
  want_benign, size - want_benign as want_attack from counts c, total t),
targets as (select source_file, cast(case when place < files then b
    else want_benign - coalesce((select sum(b) from ordered o where o.place < o.files), 0) end as bigint) as benign,
  cast(case when place < files then a
    else want_attack - coalesce((select sum(a) from ordered o where o.place < o.files), 0) end as bigint) as attack from ordered),
sampled as (select f.* from (select *, row_number() over (partition by source_file, label order by md5(concat_ws('|', '42', l_orderkey,
    l_partkey, l_linenumber, cast(in_bytes as bigint), cast(out_bytes as bigint)))) as place from flows) f join targets t
   on f.source_file = t.source_file and place <= case label when 0 then benign else attack end)"""

#: The same with as many rows as the class ratio allows.
WHOLE_FLOWS_SQL = FLOWS_SQL.replace("least(20000, ", "least(")


def numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with numeric columns; the text columns used as sampling key are kept beside them."""
    text = I.training_flows(spark, sf)
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "source_file"]
    kept = text.select(*keys, *[F.col(c) for c in FLOW_CSV_COLUMNS])
    rows = kept.withColumns({"in_text": F.col("IN_BYTES"), "out_text": F.col("OUT_BYTES")})
    return readers.numeric_flows(rows)


SAMPLE_KEY = ["l_orderkey", "l_partkey", "l_linenumber", "in_text", "out_text"]


def sample(spark: SparkSession, sf: str, max_samples: int | None = 20_000) -> DataFrame:
    return training.balanced_sample(numeric(spark, sf), SAMPLE_KEY, max_samples=max_samples)


ROUNDS = 40


def learnable(rows: DataFrame) -> DataFrame:
    """Rows whose label follows protocol and duration, but for one order in 25."""
    attack = (F.col("protocol") == 6) & (F.col("duration") < 2.5)
    return rows.withColumn("label", (attack != (F.col("l_orderkey") % 25 == 0)).cast("int"))


def score_by_joins(features: DataFrame, nodes: DataFrame, depth: int = 6) -> DataFrame:
    """(event_id, expected): probability by following stored tree nodes, one join for each level."""
    base, last = nodes.where("tree < 0").select("value").scalar(), nodes.agg(F.max("tree")).scalar()
    value = F.create_map(*[x for f in MODEL_FEATURES for x in (F.lit(f), F.col(f).cast("float").cast("double"))])
    trees = F.explode(F.sequence(F.lit(0), last))  # as many as rounds at most
    at = features.select("event_id", value.alias("x"), trees.alias("tree")).withColumn("node", F.lit(1))
    for level in range(depth + 1):
        at = at.select("event_id", "x", "tree", "node").join(F.broadcast(nodes), ["tree", "node"])
        right = F.coalesce(F.col("x")[F.col("feature")] > F.col("cut"), F.lit(False)).cast("int")
        if level < depth:
            at = at.withColumn("node", F.when(F.col("feature").isNotNull(), 2 * F.col("node") + right).otherwise(F.col("node")))
    return at.groupBy("event_id").agg((1 / (1 + F.exp(-(F.sum("value") + base)))).alias("expected"))


def written_feedback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "feedback")
    sinks.append_feedback(decided(spark, sf), path)
    return readers.read_feedback(spark, path)


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as training runs, one registry per customer; most compete, some are forced."""
    k = F.col("o_orderkey")
    return I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("registry"),
        k.alias("seq"),
        F.concat(F.lit("run_"), k.cast("string")).alias("run_id"),
        (F.floor(F.col("o_totalprice")) % 1000 / 1000.0).alias("val_f1"),
        ((k % 97) / 100.0).alias("val_precision"),
        ((k % 89) / 100.0).alias("val_recall"),
        F.when(k % 7 == 0, "force").otherwise("run").alias("kind"),
    )


RUNS_SQL = """runs as (select o_custkey as registry, o_orderkey as seq, 'run_' || cast(o_orderkey as varchar) as run_id,
  floor(o_totalprice) % 1000 / 1000.0::double as val_f1, (o_orderkey % 97) / 100.0::double as val_precision,
  (o_orderkey % 89) / 100.0::double as val_recall, o_orderkey % 7 = 0 as forced from orders),
numbered as (select *, row_number() over (partition by registry order by seq) as place from runs),
steps as (select registry, place, run_id, val_f1, val_f1 as active, run_id as active_id, true as promoted, -1.0::double as before
   from numbered where place = 1
 union all select n.registry, n.place, n.run_id, n.val_f1, case when n.forced or n.val_f1 >= s.active then n.val_f1 else s.active end,
   case when n.forced or n.val_f1 >= s.active then n.run_id else s.active_id end, n.forced or n.val_f1 >= s.active, s.active
  from steps s join numbered n on n.registry = s.registry and n.place = s.place + 1)"""

TICKS_SQL = "ticks as (select t as threshold from (values " + ", ".join(f"({t!r}::double)" for t in models.THRESHOLDS) + ") v(t))"
SCORES_SQL = """scores as (select event_id, prob, cast(case when event_id % 10 < 2 then event_id % 2
   else cast(prob >= 0.5::double as int) end as integer) as label
  from (select event_id, least(abs(value) / 100.0::double, 1) as prob from events))"""
CONFUSION_SQL = f"""{SCORES_SQL}, {TICKS_SQL},
confusion as (select threshold, count(*) filter (prob >= threshold and label = 1) as tp,
  count(*) filter (prob >= threshold and label = 0) as fp, count(*) filter (prob < threshold and label = 1) as fn
  from scores, ticks group by 1),
rated as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from confusion),
measured as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rated)"""
FEATURE_SQL = """cast(in_pkts + out_pkts as float) as total_frames, cast(in_bytes + out_bytes as float) as total_bytes,
  cast(duration as float) as duration, cast((in_bytes + out_bytes) / greatest(in_pkts + out_pkts, 1) as float) as avg_pkt_size,
  cast((in_pkts + out_pkts) / duration as float) as pkts_per_sec, cast((in_bytes + out_bytes) / duration as float) as bytes_per_sec,
  cast(protocol as float) as protocol, label"""
FEEDBACK_SQL = """feedback as (select id as alert_id, total_frames, total_bytes, duration, avg_pkt_size, pkts_per_sec, bytes_per_sec,
  protocol_code as protocol, case when status = 'resolved' then 1 else 0 end as label from decided where status <> 'pending')"""


def doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.round(F.col(f).cast("double"), 6) for f in MODEL_FEATURES})


ROUNDED_FEATURES = ", ".join(f"round({f}::double, 6) as {f}" for f in MODEL_FEATURES)


def register(c: Catalog) -> None:
    @c.add(
        "prj5_training_features",
        f"with {FLOWS_SQL} select l_orderkey, l_partkey, l_linenumber, {ROUNDED_FEATURES}, label from "
        f"(select l_orderkey, l_partkey, l_linenumber, {FEATURE_SQL} from flows)",
    )
    def prj5(spark, sf):
        return doubles(training.training_features(numeric(spark, sf), "l_orderkey", "l_partkey", "l_linenumber"))

    @c.add(
        "ml3_training_features",
        f"""with {FLOWS_SQL} select source_file, label, count(*) as n, sum(total_frames::double) as frames,
            sum(total_bytes::double) as bytes, max(protocol::double) as protocol
            from (select source_file, {FEATURE_SQL} from flows) group by 1, 2""",
    )
    def ml3(spark, sf):
        """The same features from the written flow files, as the training job reads them."""
        path = scratch_path(spark, "flow-files")
        rows = I.training_flows(spark, sf).select("source_file", *FLOW_CSV_COLUMNS)
        rows.write.option("header", True).partitionBy("source_file").csv(path)
        flow_rows = readers.read_flow_csv(spark, path)
        named = flow_rows.withColumn("source_file", F.regexp_extract("source_file", "source_file=([^/]*)", 1))
        features = training.training_features(named, "source_file")
        total = lambda c, name: F.sum(F.col(c).cast("double")).alias(name)
        return features.groupBy("source_file", "label").agg(
            F.count(F.lit(1)).alias("n"), total("total_frames", "frames"), total("total_bytes", "bytes"),
            F.max(F.col("protocol").cast("double")).alias("protocol"),
        )

    @c.add("agg9_class_counts", f"with {FLOWS_SQL} select source_file, benign, attack from counts")
    def agg9(spark, sf):
        return training.class_counts(numeric(spark, sf))

    @c.add("ml1_allocate_targets", f"with {FLOWS_SQL} select source_file, benign, attack from targets")
    def ml1(spark, sf):
        return training.allocate_targets(training.class_counts(numeric(spark, sf)), 0.9, 0.1, 20_000)

    @c.add(
        "ml2_stratified_sample",
        f"with {FLOWS_SQL} select source_file, l_orderkey, l_partkey, l_linenumber, label from sampled",
    )
    def ml2(spark, sf):
        return sample(spark, sf).select("source_file", "l_orderkey", "l_partkey", "l_linenumber", "label")

    @c.add(
        "ml5_stratified_split",
        f"""with {FLOWS_SQL} select l_orderkey, l_partkey, l_linenumber, label, place <= floor(size * 0.2::double) as is_val from (
         select *, count(*) over (partition by label) as size, row_number() over (partition by label order by md5(concat_ws('|', '42',
           l_orderkey, l_partkey, l_linenumber, cast(in_bytes as bigint), cast(out_bytes as bigint)))) as place from flows)""",
    )
    def ml5(spark, sf):
        rows = training.training_features(numeric(spark, sf), *SAMPLE_KEY)
        split = training.stratified_split(rows, SAMPLE_KEY)
        return split.select("l_orderkey", "l_partkey", "l_linenumber", "label", "is_val")

    feedback_sql = DECIDED_SQL.rstrip() + ",\n" + FEEDBACK_SQL

    @c.add("ml4_feedback_samples", feedback_sql + f" select alert_id, {ROUNDED_FEATURES}, label from feedback")
    def ml4(spark, sf):
        return doubles(training.feedback_samples(written_feedback(spark, sf)))

    @c.add(
        "src9_read_feedback",
        DECIDED_SQL
        + """select id as alert_id, status as decision, type, src_ip, t_us, event_id + 8400000000 as decision_us
             from decided where status in ('ignored', 'resolved')""",
    )
    def src9(spark, sf):
        rows = readers.read_feedback(spark, written_lines(decisions.feedback_rows(decided(spark, sf)), "feedback-lines"))
        return rows.select(
            "alert_id", "decision", "alert.type", "alert.src_ip", F.unix_micros(S.parse_iso(F.col("alert.timestamp"))).alias("t_us"),
            F.unix_micros(S.parse_iso(F.col("decision_timestamp"))).alias("decision_us"),
        )

    union_sql = lambda flows_sql: (
        feedback_sql + ", " + flows_sql
        + f""", joined as (select {FEATURE_SQL}, false as from_feedback from sampled union all select cast(total_frames as float),
          cast(total_bytes as float), cast(duration as float), cast(avg_pkt_size as float), cast(pkts_per_sec as float),
          cast(bytes_per_sec as float), cast(protocol as float), label, true from feedback)"""
    )

    @c.add(
        "set3_training_union",
        union_sql(FLOWS_SQL) + " select from_feedback, label, count(*) as n, sum(total_frames::double) as frames from joined group by 1, 2",
    )
    def set3(spark, sf):
        rows = training.training_union(sample(spark, sf), training.feedback_samples(written_feedback(spark, sf)))
        return rows.groupBy("from_feedback", "label").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("total_frames").cast("double")).alias("frames")
        )

    @c.add(
        "agg14_attack_ratio",
        union_sql(WHOLE_FLOWS_SQL)
        + """ select round(avg(label), 6) as attack_ratio, count(*) as sampled_rows,
             count(*) filter (from_feedback) as feedback_rows_used from joined""",
    )
    def agg14(spark, sf):
        rows = training.training_union(sample(spark, sf, None), training.feedback_samples(written_feedback(spark, sf)))
        return training.attack_ratio(rows).withColumn("attack_ratio", F.round("attack_ratio", 6))

    @c.add(
        "agg11_confusion_by_threshold",
        f"with {CONFUSION_SQL} select threshold, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from measured",
    )
    def agg11(spark, sf):
        rows = models.confusion_by_threshold(I.scored_events(spark, sf))
        return rows.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})

    @c.add(
        "ml7_pick_threshold",
        f"""with {CONFUSION_SQL} select threshold, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall
            from measured order by measured.f1 desc, threshold limit 1""",
    )
    def ml7(spark, sf):
        return models.pick_threshold(I.scored_events(spark, sf)).withColumns(
            {m: F.round(m, 6) for m in ("precision", "recall", "f1")}
        )

    @c.add(
        "ml12_eval_metrics",
        f"""with {SCORES_SQL}, curve as (select prob, sum(p) over (order by prob desc) as tp, sum(n) over (order by prob desc) as fp,
             sum(p) over () as pos, sum(n) over () as neg from (select prob, sum(label) as p, sum(1 - label) as n from scores group by 1)),
           points as (select tp / pos as recall, fp / neg as fpr, tp / (tp + fp) as precision,
             lag(tp / pos) over (order by prob desc) as r0, lag(fp / neg) over (order by prob desc) as f0,
             lag(tp / (tp + fp)) over (order by prob desc) as p0 from curve)
           select round(sum((fpr - coalesce(f0, 0)) * (recall + coalesce(r0, 0)) / 2), 6) as auc,
             round(sum((recall - coalesce(r0, 0)) * (precision + coalesce(p0, precision)) / 2), 6) as aucpr,
             (select round(avg(-case when label = 1 then ln(q) else ln(1 - q) end), 6)
               from (select label, least(greatest(prob, 1e-15::double), 1 - 1e-15::double) as q from scores)) as logloss from points""",
    )
    def ml12(spark, sf):
        metrics = models.eval_metrics(I.scored_events(spark, sf))
        return metrics.select(*[F.round(m, 6).alias(m) for m in ("auc", "aucpr", "logloss")])

    @c.add(
        "ml6_train_model",
        f"""with {FLOWS_SQL}, learnable as (select case when (protocol = 6 and duration < 2.5) <> (l_orderkey % 25 = 0) then 1 else 0 end as label
             from sampled), halves as (select label, count(*) as n, cast(floor(count(*) * 0.2::double) as bigint) as val_rows
             from learnable group by 1)
            select label, n - val_rows as train_rows, val_rows, true as round_in_range, true as halves_constant_loss, true as finds_attacks
            from halves""",
    )
    def ml6(spark, sf):
        """A model has no SQL form; what must hold of it has.

        The labels follow protocol and duration but for one row in 25, which no model can know. 40 rounds must leave less
        than half the log loss of a constant on validation rows, and an F1 of 0.9; a useless model does neither.
        """
        split = materialize(training.stratified_split(learnable(sample(spark, sf)), SAMPLE_KEY), "split")
        trained = models.train(split, rounds=ROUNDS)
        scored = models.score_rows(split.where("is_val"), trained.model).select("label", F.col("ml").alias("prob"))
        f1 = models.pick_threshold(scored).first()["f1"]
        counts = split.groupBy("label").agg(
            F.count_if(~F.col("is_val")).alias("train_rows"), F.count_if("is_val").alias("val_rows")
        )
        share = split.where("is_val").agg(F.avg("label")).first()[0]
        constant = -(share * math.log(share) + (1 - share) * math.log(1 - share))
        return counts.select(
            "label", "train_rows", "val_rows",
            F.lit(0 <= trained.best_iteration < ROUNDS).alias("round_in_range"),
            F.lit(trained.best_score < constant / 2).alias("halves_constant_loss"),
            F.lit(f1 > 0.9).alias("finds_attacks"),
        )

    @c.add(
        "ml8_score_events",
        O.WITH_PACKETS + "select event_id, true as equals_stored_trees, true as label_follows_threshold from packets",
    )
    def ml8(spark, sf):
        """Trained, stored, promoted and loaded again by the training job; then scores all packets.

        The score is held against that of the stored nodes themselves, which joins evaluate level by level.
        """
        store = scratch_path(spark, "model-store")
        rows = learnable(sample(spark, sf)).select(*MODEL_FEATURES, "label", *SAMPLE_KEY, F.lit(False).alias("from_feedback"))
        training_job.run_job(rows, SAMPLE_KEY, store, "run_1", "2026-01-01T00:00:00Z", rounds=8)
        active = training_job.load_active(spark, store)
        features = materialize(flows.flow_features(I.packets(spark, sf)), "event-features")
        scored = models.score_events(features, active.threshold, active.model).select("event_id", "ml", "ml_label")
        expected = score_by_joins(features, spark.read.parquet(f"{store}/models/run_1"))
        attack = F.col("ml_label") == "xgboost_anomaly"
        return scored.join(expected, "event_id", "left").select(
            "event_id",
            F.coalesce(F.abs(F.col("ml") - F.col("expected")) < 1e-9, F.lit(False)).alias("equals_stored_trees"),
            (attack == (F.col("ml") >= active.threshold)).alias("label_follows_threshold"),
        )

    @c.add(
        "ml8_score_events_fallback",
        O.WITH_FEATURES
        + "select event_id, round(ml, 6) as ml, case when ml >= 0.5::double then 'xgboost_anomaly' else 'benign' end as ml_label from scored",
    )
    def ml8_fallback(spark, sf):
        scored = models.score_events(flows.flow_features(I.packets(spark, sf)), 0.5)
        return scored.select("event_id", F.round("ml", 6).alias("ml"), "ml_label")

    @c.add(
        "win8_run_deltas",
        f"""with recursive {RUNS_SQL}, ends as (select registry, count(*) as runs, arg_min(val_f1, seq) as f0, arg_max(val_f1, seq) as f1,
             arg_min(val_precision, seq) as p0, arg_max(val_precision, seq) as p1, arg_min(val_recall, seq) as r0,
             arg_max(val_recall, seq) as r1 from runs group by 1)
            select registry, runs, round((f1 - f0) * 100, 6) as f1_delta, round((p1 - p0) * 100, 6) as precision_delta,
             round((r1 - r0) * 100, 6) as recall_delta from ends where runs > 1""",
    )
    def win8(spark, sf):
        rows = models.run_deltas(run_events(spark, sf))
        return rows.withColumns({f"{m}_delta": F.round(f"{m}_delta", 6) for m in ("f1", "precision", "recall")})

    @c.add(
        "ml10_active_run",
        f"""with recursive {RUNS_SQL} select registry, arg_max(active_id, place) as current_run_id, arg_max(active, place) as current_f1,
            max(val_f1) as best_val_f1 from steps group by 1""",
    )
    def ml10(spark, sf):
        return models.active_run(run_events(spark, sf))

    @c.add(
        "snk6_append_run",
        f"with recursive {RUNS_SQL} select registry, run_id, val_f1, promoted, before as active_f1_before from steps",
    )
    def snk6(spark, sf):
        path = scratch_path(spark, "runs")
        decided_runs = models.promotions(run_events(spark, sf))
        sinks.append_run(decided_runs, path)
        return spark.read.schema(decided_runs.schema).json(path).select(
            "registry", "run_id", "val_f1", "promoted", "active_f1_before"
        )
