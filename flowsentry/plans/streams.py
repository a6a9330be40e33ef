"""Catalogue queries that run a stream over files written from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators import cascade, intel
from flowsentry.plans import inputs as I
from flowsentry.plans import oracle as O
from flowsentry.plans.alert_views import ALERTS_AND, BLOCKS_SQL, alert_store
from flowsentry.plans.catalog import Catalog
from flowsentry.plans.detection import ALERT_OUT, ROUNDED, ROUNDED_SQL, rounded
from flowsentry.session import scratch_path
from flowsentry.sources import readers
from flowsentry.streaming import jobs
from flowsentry.streaming.keyed import KeyedStream

#: Less than a batch's stretch of the test tables' time, so that rows are released while the rest still waits.
DELAY_US = 300_000_000


#: Files a stream of the whole table arrives in; each is a micro-batch.
BATCHES = 5


def packet_stream(spark: SparkSession, sf: str, rows: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, str]:
    path = path or scratch_path(spark, "packets")
    rows = I.packets(spark, sf) if rows is None else rows
    rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path), path


def dealt_out(spark: SparkSession, rows: DataFrame, stretch: Column) -> DataFrame:
    """The rows with their ``stretch``, a folder for each: made once, and a stretch is read without the others."""
    path = scratch_path(spark, "stretches")
    rows = rows.withColumn("stretch", stretch)
    rows.write.partitionBy("stretch").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def run_in_batches(spark: SparkSession, job: KeyedStream, rows: DataFrame, batches: int = BATCHES) -> None:
    """All rows in order of time, in equal stretches of time, one micro-batch after the other."""
    path = scratch_path(spark, "batches")
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    length = (last - first) // batches + 1
    stretches = dealt_out(spark, rows, F.floor((F.col("t_us") - first) / length))
    for n in range(batches):
        stretches.where(F.col("stretch") == n).select(*rows.columns).write.mode("append").parquet(path)
        job.start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
    job.finish()


def alert_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "alerts")
    store = alert_store(spark, sf)
    store.write.parquet(path)
    return spark.readStream.schema(store.schema).parquet(path)


def register(c: Catalog) -> None:
    @c.add("str1_stream_cascade", O.WITH_ALERTS + f"select {', '.join(ALERT_OUT)} from alerts")
    def str1(spark, sf):
        job = jobs.CascadeStream(
            spark, scratch_path(spark, "cascade"), DELAY_US, I.indicators(spark, sf), I.cascade_rules(spark, sf)
        )
        run_in_batches(spark, job, I.packets(spark, sf))
        return job.alerts().select(*ALERT_OUT)

    @c.add(
        "str1_stream_blocks",
        ALERTS_AND + BLOCKS_SQL + " select src_ip, t_us, event_id, reason, 'block-signature' as mode from blocks",
    )
    def str1_blocks(spark, sf):
        config = cascade.CascadeConfig(mode="block-signature")
        job = jobs.CascadeStream(
            spark, scratch_path(spark, "cascade"), DELAY_US, I.indicators(spark, sf), I.cascade_rules(spark, sf), config
        )
        run_in_batches(spark, job, I.packets(spark, sf), 2)
        return job.blocks().select("src_ip", "t_us", "event_id", "reason", "mode")

    @c.add(
        "str2_stream_flow_state",
        O.WITH_FEATURES + f"select event_id, session_start_us, total_frames, total_bytes, {ROUNDED_SQL} from features",
    )
    def str2(spark, sf):
        job = jobs.FlowFeatureStream(spark, scratch_path(spark, "flows"), DELAY_US)
        run_in_batches(spark, job, I.packets(spark, sf))
        features = job.features()
        return rounded(features.select("event_id", "session_start_us", "total_frames", "total_bytes", *ROUNDED))

    @c.add(
        "str3_stream_sliding_threshold",
        O.WITH_LOGIN
        + """select event_id, 'SYNFloodIndicator' as name, 0.96::double as severity from syn_hits
             union all select event_id, name, round(severity, 6) from login_hits""",
    )
    def str3(spark, sf):
        flagged = intel.ioc_match(I.packets(spark, sf), I.indicators(spark, sf))
        job = jobs.ThresholdStream(spark, scratch_path(spark, "thresholds"), DELAY_US)
        run_in_batches(spark, job, flagged)
        return job.hits().withColumn("severity", F.round("severity", 6))

    @c.add(
        "str4_stream_alert_minutes",
        O.WITH_ALERTS
        + """select src_ip, type, t_us // 60000000 * 60000000 as window_us, count(*) as count, max(score) as max_score
             from alerts group by 1, 2, 3""",
    )
    def str4(spark, sf):
        path = scratch_path(spark, "minutes")
        alerts = alert_stream(spark, sf)
        jobs.write_alert_minutes(alerts, path, "5 minutes").awaitTermination()
        jobs.close_alert_minutes(alerts, path, "5 minutes")
        rows = jobs.read_alert_minutes(spark, path)
        return rows.select("src_ip", "type", F.unix_micros("window").alias("window_us"), "count", "max_score")

    @c.add(
        "str5_stream_first_block",
        ALERTS_AND + BLOCKS_SQL + " select src_ip, t_us, reason, 'block-signature' as mode from blocks",
    )
    def str5(spark, sf):
        path = scratch_path(spark, "first-blocks")
        jobs.write_first_blocks(alert_stream(spark, sf), path).awaitTermination()
        rows = readers.read_block_log(spark, f"{path}/blocks")
        return rows.select("src_ip", F.unix_micros("ts").alias("t_us"), "reason", "mode")

    @c.add(
        "str6_late_rows",
        O.WITH_PACKETS
        + """select event_id, t_us from packets where event_id % 10 = 0
             and t_us < (select (max(t_us) // 1000 - 300000) * 1000 from packets where event_id % 10 <> 0)""",
    )
    def str6(spark, sf):
        """A tenth of the packets arrives after all others."""
        packets = I.packets(spark, sf)
        delayed = F.col("event_id") % 10 == 0
        job = jobs.FlowFeatureStream(spark, scratch_path(spark, "late"), DELAY_US)
        events, path = packet_stream(spark, sf, packets.where(~delayed))
        job.start(events).awaitTermination()
        events, _ = packet_stream(spark, sf, packets.where(delayed), path)
        job.start(events).awaitTermination()
        return job.late_rows().select("event_id", "t_us")
