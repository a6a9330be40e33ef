"""Stream jobs: flow features, thresholds, the full cascade, minute groups and first blocks."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsentry.functions import scalars as S
from flowsentry.operators import cascade, flows, intel
from flowsentry.operators import rules as rules_of
from flowsentry.operators.cooldown import FIRST, greedy
from flowsentry.operators.flows import FLOW_KEY, IDLE_GAP_US
from flowsentry.operators.thresholds import SECOND, SEVERITY_EXTRA, LoginService, SynFlood
from flowsentry.sources import sinks
from flowsentry.streaming.keyed import KeyedStream, end_mark, stream_settings

SESSION = {"session_start_us": "long", "total_frames": "double", "total_bytes": "double"}


def is_record(rows: DataFrame):
    return flows.is_record() if set(flows.COUNTERS) <= set(rows.columns) else F.lit(False)


def continued(t: np.ndarray, size: np.ndarray, open_session: list | None, gap_us: int) -> tuple[list[np.ndarray], list]:
    """([session start, frames, bytes] at each packet of a flow, the session left open: start, last time, totals)."""
    start, last, frames, total = open_session or (int(t[0]), int(t[0]), 0.0, 0.0)
    cut = np.diff(t, prepend=last) > gap_us
    at = np.maximum.accumulate(np.where(cut, np.arange(len(t)), -1))
    before = np.concatenate([[0.0], np.cumsum(size)])
    starts = np.where(at < 0, start, t[np.maximum(at, 0)])
    counts = np.arange(1, len(t) + 1) - np.where(at < 0, -frames, at)
    sums = before[1:] - np.where(at < 0, -total, before[np.maximum(at, 0)])
    return [starts, counts.astype(float), sums], [int(starts[-1]), int(t[-1]), float(counts[-1]), float(sums[-1])]


def trailing(t: np.ndarray, need: int, within_us: int) -> np.ndarray:
    """Whether the ``need`` rows up to each row lie within the window."""
    hit = np.zeros(len(t), bool)
    hit[need - 1 :] = t[need - 1 :] - t[: max(0, len(t) - need + 1)] <= within_us
    return hit


def kept_rows(t: np.ndarray, hits: np.ndarray, last: int | None, cooldown_us: int) -> np.ndarray:
    """Rows of ``hits`` that the cooldown lets through; of equal times the first."""
    at = np.flatnonzero(hits)
    times, first = np.unique(t[at], return_index=True)
    kept = greedy(times, FIRST if last is None else last + cooldown_us, cooldown_us)
    return at[first[np.searchsorted(times, kept)]]


def flow_rules(gap_us: int, ready: pd.DataFrame | None, memory: list | None, watermark: int):
    """Running totals of one flow; its open session is kept until it can no longer be continued."""
    if ready is not None:
        ready = ready.assign(session_start_us=None, total_frames=0.0, total_bytes=0.0)
        packets = (~ready["record"]).to_numpy(bool)
        if packets.any():
            t, size = (ready.loc[packets, c].to_numpy() for c in ("t_us", "size"))
            totals, memory = continued(t, size, memory, gap_us)
            for name, values in zip(SESSION, totals):
                ready.loc[packets, name] = values
    if memory is not None and memory[1] + gap_us < watermark:
        memory = None
    return ready, memory, None if memory is None else memory[1] + gap_us


def source_rules(
    syn: SynFlood, services: list[LoginService], gap_us: int, blocks: bool, ready: pd.DataFrame | None, memory: dict | None, watermark: int
):
    """SYN flood and login hits, running totals by flow, and the first signature of one source.

    The memory holds the times that can still count, the last alerts, the open sessions and whether a signature was
    seen; all but the last go once they can no longer matter.
    """
    memory = memory or {"syn": [[], None], "ports": {}, "flows": {}, "blocked": False}
    if ready is not None:
        n = len(ready)
        t, port = ready["t_us"].to_numpy(), ready["port"].to_numpy()
        name, severity, rest = np.full(n, None, object), np.full(n, np.nan), ready["syn"].to_numpy(bool)

        def counted(rows: np.ndarray, known: list, need: int, window_us: int, cooldown_us: int, extra: int):
            """(rows kept, how many rows beyond ``need`` lie in their windows); ``known`` is [times before, last alert]."""
            times = np.concatenate([np.array(known[0], np.int64), t[rows]])
            kept = kept_rows(times, trailing(times, need, window_us) & (np.arange(len(times)) >= len(known[0])), known[1], cooldown_us)
            over = sum((trailing(times, need + j, window_us)[kept].astype(int) for j in range(1, extra + 1)), np.zeros(len(kept), int))
            if len(kept):
                known[1] = int(times[kept[-1]])
            kept = rows[kept - len(known[0])]
            known[0] = times[-(need - 1 + extra) :].tolist()
            return kept, over

        rows = np.flatnonzero(rest)
        kept, _ = counted(rows, memory["syn"], syn.count, syn.window_us, syn.cooldown_us, 0)
        name[kept], severity[kept], rest[kept] = syn.name, syn.severity, False
        for s in services:
            rows = np.flatnonzero(rest & (port == s.port))
            if len(rows):
                known = memory["ports"].setdefault(str(s.port), [[], None])
                kept, over = counted(rows, known, s.attempts, s.window_s * SECOND, s.cooldown_s * SECOND, SEVERITY_EXTRA)
                name[kept], severity[kept] = f"L7BruteForce_{s.service}", np.minimum(0.95 + 0.01 * over, 0.99)
        first_block = np.zeros(n, bool)
        if blocks and not memory["blocked"]:
            signed = np.flatnonzero(ready["named"].to_numpy(bool) & (ready["signed"].to_numpy(bool) | (name != None)))  # noqa: E711
            first_block[signed[:1]] = memory["blocked"] = len(signed) > 0
        # One array for each result, filled flow by flow; only a record has no session.
        packets = np.flatnonzero(~ready["record"].to_numpy(bool))
        session = [np.full(n, None, object) if len(packets) < n else np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
        flow = ready["flow"].iloc[packets].astype("category").cat.remove_unused_categories()
        packets, size = packets[np.argsort(flow.cat.codes.to_numpy(), kind="stable")], ready["size"].to_numpy()
        ends = np.cumsum(np.bincount(flow.cat.codes, minlength=len(flow.cat.categories)))
        for seen, at in zip(flow.cat.categories, np.split(packets, ends[:-1])):
            totals, memory["flows"][seen] = continued(t[at], size[at], memory["flows"].get(seen), gap_us)
            for column, values in zip(session, totals):
                column[at] = values
        ready = ready.assign(hit_name=name, hit_severity=severity, **dict(zip(SESSION, session)), first_block=first_block)

    def current(known: list, window_us: int, cooldown_us: int) -> list:
        last = known[1] if known[1] is not None and known[1] + cooldown_us > watermark else None
        return [[x for x in known[0] if x + window_us >= watermark], last]

    limits = {str(s.port): (s.window_s * SECOND, s.cooldown_s * SECOND) for s in services}
    memory["syn"] = current(memory["syn"], syn.window_us, syn.cooldown_us)
    ports = {p: current(k, *limits[p]) for p, k in memory["ports"].items()}
    memory["ports"] = {p: k for p, k in ports.items() if k != [[], None]}
    memory["flows"] = {f: m for f, m in memory["flows"].items() if m[1] + gap_us >= watermark}
    ends = [m[1] + gap_us for m in memory["flows"].values()]
    for known, (window_us, cooldown_us) in [(memory["syn"], (syn.window_us, syn.cooldown_us)), *((k, limits[p]) for p, k in memory["ports"].items())]:
        ends += [x + window_us for x in known[0][-1:]] + ([known[1] + cooldown_us] if known[1] is not None else [])
    return ready, memory if ends or memory["blocked"] else None, max(ends, default=None)


class FlowFeatureStream(KeyedStream):
    """Running flow features of every event; state by flow."""

    facts = {"size": "double", "record": "boolean"}
    results = SESSION

    def prepared(self, events):
        self.record = is_record(events)
        return events

    def key(self):
        return F.struct(*FLOW_KEY)

    def fact_columns(self):
        return {"size": F.coalesce(F.col("packet_size"), F.lit(0)).cast("double"), "record": F.coalesce(self.record, F.lit(False))}

    def rules(self):
        return partial(flow_rules, IDLE_GAP_US)

    def finished(self, rows):
        return flows.kept_flow_features(rows)

    def features(self) -> DataFrame:
        return self.written().where("not late").drop("late")


class ThresholdStream(KeyedStream):
    """SYN flood and login brute-force hits; rows bring an ``ioc`` flag. State by source."""

    facts = {"size": "double", "record": "boolean", "syn": "boolean", "port": "int", "signed": "boolean", "named": "boolean", "flow": "string"}
    results = {"hit_name": "string", "hit_severity": "double", **SESSION, "first_block": "boolean"}

    def __init__(self, spark: SparkSession, path: str, delay_us: int, config: cascade.CascadeConfig | None = None) -> None:
        super().__init__(spark, path, delay_us)
        self.config = config or cascade.CascadeConfig()

    def prepared(self, events):
        self.record = is_record(events)
        return events.withColumn("rule", F.lit(None).cast("string"))

    def key(self):
        return F.col("src_ip")

    def fact_columns(self):
        return {
            "size": F.coalesce(F.col("packet_size"), F.lit(0)).cast("double"),
            "record": F.coalesce(self.record, F.lit(False)),
            "syn": F.coalesce(S.syn_only(F.col("proto"), F.col("flags")) & ~F.col("ioc"), F.lit(False)),
            "port": F.coalesce(F.col("dst_port"), F.lit(-1)),
            "signed": F.coalesce(F.col("ioc"), F.lit(False)) | F.col("rule").isNotNull(),
            "named": F.coalesce(F.col("src_ip"), F.lit("")) != "",
            "flow": F.to_json(F.struct(*FLOW_KEY)),
        }

    def rules(self):
        return partial(source_rules, self.config.syn, self.config.services, IDLE_GAP_US, self.config.mode == "block-signature")

    def hits(self) -> DataFrame:
        hits = self.written().where("not late and hit_name is not null")
        return hits.select("event_id", F.col("hit_name").alias("name"), F.col("hit_severity").alias("severity"))


class CascadeStream(ThresholdStream):
    """The whole cascade: events in, alerts, block rows and analyst queue out.

    Indicators and rules are matched row by row before the rows are dealt out by source; a source's counting stages, its
    flows and its first block are one state, and scores follow from that row by row.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        delay_us: int,
        indicators: DataFrame,
        rules: DataFrame,
        config: cascade.CascadeConfig | None = None,
    ) -> None:
        super().__init__(spark, path, delay_us, config)
        # Constant over the life of the stream, so they are counted and written once.
        self.indicators, self.rule_table = intel.indicator_set(indicators), rules_of.rule_table(rules)

    def prepared(self, events):
        self.record = is_record(events)
        matched = rules_of.first_rule_match(intel.ioc_match(events, self.indicators), self.rule_table)
        rule = F.struct(*[F.col("rule")[c].alias(c) for c in ("name", "severity", "sid", "source_engine")])
        return matched.withColumn("rule", F.when(F.col("rule").isNotNull(), rule))

    def finished(self, rows):
        features = flows.kept_flow_features(rows).withColumn("sig", cascade.signature_of(F.col("rule")))
        scored = cascade.scored(features, self.config)
        scored = scored.withColumn("sig", F.when(~F.col("late"), F.col("sig"))).withColumn("ml_label", F.when(~F.col("late"), F.col("ml_label")))
        return cascade.build_alerts(scored, self.config.mode, F.col("late"), ("t_us", "late", "first_block"))

    def alerts(self) -> DataFrame:
        return self.written().where("not late").drop("late", "first_block", "t_us")

    def blocks(self) -> DataFrame:
        """First signature of each source; only in mode ``block-signature``."""
        return self.written().where("first_block").select(
            "src_ip", "t_us", "event_id", F.expr("substring(type, 11)").alias("reason"), F.lit(self.config.mode).alias("mode")
        )

    def soc_queue(self) -> DataFrame:
        return cascade.soc_queue(self.alerts())


def alert_minutes(alerts: DataFrame, delay: str) -> DataFrame:
    """Streaming minute groups of alerts; a minute is final once the watermark has passed it."""
    return _minutes(alerts.withWatermark("ts", delay))


def _minutes(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("src_ip", "type", F.coalesce("status", F.lit("pending")).alias("status"), F.window("ts", "1 minute").alias("_w"))
        .agg(F.count(F.lit(1)).alias("count"), F.max("score").alias("max_score"), F.max("ts").alias("latest_ts"))
        .select("src_ip", "type", F.col("_w.start").alias("window"), "status", "count", "max_score", "latest_ts")
    )


def write_alert_minutes(alerts: DataFrame, path: str, delay: str, **trigger) -> StreamingQuery:
    """Append each minute's groups when the watermark has passed it; every minute is written once, over any restarts."""
    spark = alerts.sparkSession
    end_mark(spark, alerts.schema, "ts", f"{path}/marks", False)
    marks = spark.readStream.schema(alerts.schema).parquet(f"{path}/marks")
    groups = alert_minutes(alerts.unionByName(marks), delay)
    writer = groups.writeStream.outputMode("append").format("parquet").option("path", f"{path}/groups")
    with stream_settings(spark):
        return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def close_alert_minutes(alerts: DataFrame, path: str, delay: str) -> None:
    """End the stream: a mark moves its watermark past all alerts, so that Spark writes the minutes it still holds.

    Run twice, or after a restart, it writes nothing again.
    """
    end_mark(alerts.sparkSession, alerts.schema, "ts", f"{path}/marks", True)
    write_alert_minutes(alerts, path, delay).awaitTermination()


def read_alert_minutes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/groups")


def write_first_blocks(alerts: DataFrame, path: str, mode: str = "block-signature", **trigger) -> StreamingQuery:
    """One block row per source for good: the log itself is the memory, so no stream state grows."""

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        sinks.append_block_log(rows, f"{path}/blocks", mode)

    writer = alerts.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def recent_blocks(alerts: DataFrame, delay: str) -> DataFrame:
    """One row per source within the watermark delay; bounded state, a quiet source may appear again."""
    hits = alerts.where(F.col("type").startswith("signature:")).withWatermark("ts", delay)
    return hits.dropDuplicatesWithinWatermark(["src_ip"])
