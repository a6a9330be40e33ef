"""The ordered detection cascade and alert construction.

Order: indicator match, SYN flood, login brute force, rule table, model score. A packet taken by one stage
is invisible to the later ones; a SYN or login candidate held back by its cooldown goes on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators import dense, flows, intel, rules as rule_ops, thresholds
from flowsentry.operators.cooldown import first_per_key
from flowsentry.operators.flows import IDENTITY
from flowsentry.session import materialize


@dataclass
class CascadeConfig:
    threshold: float = 0.75
    mode: str = "detect-only"
    syn: thresholds.SynFlood = field(default_factory=thresholds.SynFlood)
    services: list = field(default_factory=lambda: thresholds.LOGIN_SERVICES)
    #: Time block of the flow windows.
    flow_block_us: int | None = None
    #: Scores feature rows (adds ``ml``); the built-in heuristic is used when none is given.
    scorer: Callable[[DataFrame], DataFrame] | None = None


def by_event(rows: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """Join ``rows`` with ``hits`` by ``flows.IDENTITY``, nulls equal, without the hits' own key columns."""
    named = hits.withColumnsRenamed({k: f"{k}_hit" for k in IDENTITY})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_hit")) for k in IDENTITY])
    return rows.join(named, same, how).drop(*[f"{k}_hit" for k in IDENTITY])


def without_events(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows an earlier stage has not taken."""
    return by_event(rows, hits.select(*IDENTITY), "left_anti")


def heuristic_scorer(features: DataFrame) -> DataFrame:
    return features.withColumn(
        "ml", L.heuristic_score(F.col("dst_port"), F.col("total_bytes"), F.col("flags_mask"), F.col("protocol"))
    )


@dataclass
class Stages:
    """Intermediate results of the counting stages, shared by batch and stream."""

    syn_rows: DataFrame
    syn_hits: DataFrame
    login_rows: DataFrame
    login_hits: DataFrame

    @property
    def hits(self) -> DataFrame:
        columns = [*IDENTITY, "name", "severity"]
        return self.syn_hits.select(*columns).unionByName(self.login_hits.select(*columns))


def counting_stages(flagged: DataFrame, config: CascadeConfig) -> Stages:
    """SYN and login detection on packets that carry an ``ioc`` flag."""
    # Narrow, few, and read by both detectors.
    syn_rows = materialize(thresholds.syn_only(flagged.where(~F.col("ioc"))).select(*IDENTITY, "dst_port"), "syn-rows")
    syn_hits = thresholds.syn_flood(syn_rows, config.syn)
    login_rows = without_events(syn_rows.where(F.col("dst_port").isin([s.port for s in config.services])), syn_hits)
    return Stages(syn_rows, syn_hits, login_rows, thresholds.login_bruteforce(login_rows, config.services))


def signature_struct(name: Column, severity: Column, sid: Column, engine: Column) -> Column:
    return F.struct(
        name.alias("name"), severity.alias("severity"), sid.alias("sid"), engine.alias("source_engine")
    )


def signature_of(rule: Column) -> Column:
    """``sig`` of a row with ``ioc``, ``hit_name`` and ``hit_severity``: the first stage that takes it, else null."""
    none = F.lit(None).cast("string")
    return (
        F.when(F.col("ioc"), signature_struct(F.lit(intel.IOC_NAME), F.lit(intel.IOC_SEVERITY), none, F.lit("otx")))
        .when(
            F.col("hit_name").isNotNull(),
            signature_struct(F.col("hit_name"), F.col("hit_severity"), none, F.lit("builtin")),
        )
        .when(rule.isNotNull(), signature_struct(rule["name"], rule["severity"], rule["sid"], rule["source_engine"]))
    )


def is_signed(rule: Column) -> Column:
    """Whether ``signature_of`` is not null, without building it."""
    return F.col("ioc") | F.col("hit_name").isNotNull() | rule.isNotNull()


def scored(features: DataFrame, config: CascadeConfig) -> DataFrame:
    """Feature rows with ``ml`` and ``ml_label``."""
    rows = (config.scorer or heuristic_scorer)(features)
    return rows.withColumn("ml_label", L.anomaly_label(F.col("ml"), config.threshold))


def score_and_match(flagged: DataFrame, stages: Stages, rules: DataFrame, config: CascadeConfig) -> DataFrame:
    """Feature rows with ``sig`` (struct or null), ``ml`` and ``ml_label``."""
    marks = stages.hits.select(*IDENTITY, F.col("name").alias("hit_name"), F.col("severity").alias("hit_severity"))
    block_us = config.flow_block_us or flows.BLOCK_US
    marked = by_event(dense.cut_blocks(flagged, flows.FLOW_KEY, block_us), marks, "left")
    features = flows.flow_features(marked, block_us=block_us)
    matched = rule_ops.first_rule_match(features, rules)
    signed = matched.withColumns({"sig": signature_of(F.col("rule")), "signed": is_signed(F.col("rule"))})
    return scored(signed, config)


def alert_columns(kind: Column, score: Column, action: Column, source: Column, sid: Column) -> list[Column]:
    """The stored alert for a feature row; its id is a digest of the event key."""
    return [
        "event_id",
        S.key_uuid(F.col("event_id"), F.col("t_us"), F.col("src_ip"), F.col("dst_ip"), kind).alias("id"),
        F.timestamp_micros("t_us").alias("ts"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        F.col("proto").alias("protocol"),
        kind.alias("type"),
        S.round4(score).alias("score"),
        action.alias("action"),
        source.alias("source"),
        S.model_struct().alias("model_features"),
        F.lit("pending").alias("status"),
        sid.alias("sid"),
    ]


def build_alerts(scored: DataFrame, mode: str, also: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """At most one alert per event: the signature if there is one, else the model's.

    ``also`` keeps further rows, ``extra`` further columns. Where the rows tell by ``signed`` whether ``sig`` is there,
    the filter goes by that: it would build the whole struct once more, in a method too long to be compiled at run time.
    """
    is_sig = F.col("sig").isNotNull()
    label = F.col("ml_label")
    confirmed = is_sig & F.contains(F.col("sig.name"), F.lit("L7BruteForce")) & (label != "benign")
    score = (
        F.when(confirmed, L.escalated_score(F.col("sig.severity"), F.col("ml")))
        .when(is_sig, F.col("sig.severity"))
        .otherwise(F.col("ml"))
    )
    kind = F.when(is_sig, F.concat(F.lit("signature:"), F.col("sig.name"))).otherwise(label)
    source = F.when(is_sig, F.col("sig.source_engine")).otherwise(F.lit("ml"))
    wanted = (F.col("signed") if "signed" in scored.columns else is_sig) | (label != "benign")
    return scored.where(wanted if also is None else wanted | also).select(
        *extra,
        *alert_columns(kind, score, L.policy_action(mode, is_sig), source, F.col("sig.sid")),
        F.when(is_sig, S.round4(F.col("ml"))).alias("ml_score"),
        F.when(confirmed, F.lit(True)).alias("hybrid_confirmed"),
        F.lit(None).cast("string").alias("ignore_justification"),
        F.lit(None).cast("string").alias("resolve_justification"),
    )


def run_cascade(
    packets: DataFrame, indicators: DataFrame, rules: DataFrame, config: CascadeConfig | None = None
) -> DataFrame:
    """Alerts for a bounded set of packets (or normalised events), each with its own ``event_id`` and a time.

    The input is read once, matched against the indicators and written; all stages read that table. Rows without an id
    or a time are refused. Rows equal in ``flows.IDENTITY`` are one event that was delivered more than once.
    """
    config = config or CascadeConfig()
    nameless = F.col("event_id").isNull() | F.col("t_us").isNull()
    seen = Observation()
    flagged = intel.ioc_match(packets.observe(seen, F.count(F.when(nameless, 1)).alias("nameless")), indicators)
    flagged = materialize(flagged, "events")
    if seen.get["nameless"]:
        raise ValueError("every event needs an event_id and a time; see readers.event_keys and readers.rejected_events")
    flagged = flows.unique_events(flagged)
    return build_alerts(score_and_match(flagged, counting_stages(flagged, config), rules, config), config.mode)


def signature_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts raised by a signature rather than the model."""
    return alerts.where(F.col("source").isin(L.SIGNATURE_SOURCES) | F.col("type").startswith("signature:"))


def block_rows(alerts: DataFrame, mode: str) -> DataFrame:
    """First signature hit per source address, as a block-log row."""
    hits = alerts.where(F.col("type").startswith("signature:")).select(
        "src_ip",
        F.unix_micros("ts").alias("t_us"),
        "event_id",
        F.expr("substring(type, 11)").alias("reason"),
    )
    return first_per_key(hits, "src_ip").withColumn("mode", F.lit(mode))


def soc_queue(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("action") == "queued_soc")
