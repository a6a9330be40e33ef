"""Append-only sinks. Every write adds files; nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions import scalars as S
from flowsentry.operators import cascade, decisions
from flowsentry.session import materialize
from flowsentry.sources import readers


def append_alerts(alerts: DataFrame, path: str, file_format: str = "json") -> None:
    """Append alerts, partitioned by day so that time-bounded reads prune folders."""
    rows = alerts.select(*decisions.alert_record(alerts), F.to_date("ts").alias("day"))
    rows.write.mode("append").partitionBy("day").format(file_format).save(path)


#: Parts of the block log; the share of it that one new address makes an append read.
BLOCK_PARTS = 256


def append_block_log(alerts: DataFrame, path: str, mode: str = "block-signature") -> None:
    """First signature hit per source that the log does not hold yet.

    The log lies in parts by a hash of the address, so an append reads only the parts its own addresses fall into, and
    of those only the addresses.
    """
    part = F.pmod(F.xxhash64("src_ip"), F.lit(BLOCK_PARTS)).cast("int")
    rows = materialize(cascade.block_rows(alerts, mode).withColumn("part", part), "blocks")
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # numbers below BLOCK_PARTS
    if not touched:
        return
    known = readers.read_block_log(alerts.sparkSession, path, touched).select("src_ip").distinct()
    rows.join(known, "src_ip", "left_anti").select(
        S.iso_text(F.timestamp_micros("t_us")).alias("timestamp"), "src_ip", "reason", "mode", "part"
    ).repartition("part").write.mode("append").partitionBy("part").json(path)


def append_soc_queue(alerts: DataFrame, path: str) -> None:
    queued = cascade.soc_queue(alerts)
    queued.select(*decisions.alert_record(queued)).write.mode("append").json(path)


def append_feedback(decided: DataFrame, path: str) -> None:
    decisions.feedback_rows(decided).write.mode("append").json(path)


def append_decisions(requests: DataFrame, path: str) -> None:
    """Validated decisions; the status overlay is this table joined to the alerts."""
    decisions.validate_decisions(requests).write.mode("append").parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").json(path)
