"""Alert groups, display orders, filters and analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators.cascade import signature_alerts
from flowsentry.session import materialize

GROUP_KEY = ["src_ip", "type", "window", "status"]
GROUP_ORDER = ["src_ip", "type", "window", "status"]

# Network layers with the keywords that assign an alert type or source to them.
LAYERS = [
    (7, "Application",
     ["Brute Force / Credential Attack", "Exploitation Attempt", "Malware / C2 Communication", "Data Exfiltration"],
     ["ssh", "telnet", "rdp", "ftp", "http", "dns", "smtp", "brute", "credential", "exploit", "c2", "malware", "exfil"]),
    (6, "Presentation", ["Exploitation Attempt"], ["ssl", "tls", "cert", "heartbleed", "poodle"]),
    (5, "Session", ["Exploitation Attempt", "Brute Force / Credential Attack"],
     ["smb", "netbios", "rpc", "socks", "445", "139"]),
    (4, "Transport", ["DDoS / SYN Flood", "Port Scan / Reconnaissance"],
     ["syn", "flood", "scan", "port", "tcp", "udp", "synflood", "ddos"]),
    (3, "Network", ["DDoS / SYN Flood", "Port Scan / Reconnaissance"],
     ["icmp", "ip", "ping", "smurf", "fragment", "spoof", "route"]),
    (2, "Data Link", ["Exploitation Attempt"], ["arp", "mac", "vlan", "802", "spanning"]),
    (1, "Physical", [], []),
]


def status_of(alerts: DataFrame) -> Column:
    """A missing or empty status counts as pending."""
    return S.text_or(F.col("status"), "pending")


def _keyed(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns(
        {
            "src_ip": F.coalesce("src_ip", F.lit("unknown")),
            "type": F.coalesce("type", F.lit("unknown")),
            "status": status_of(alerts),
            "window": S.minute_floor(F.col("ts")),
            "_score": F.coalesce("score", F.lit(0.0)),
        }
    )


def group_alerts(alerts: DataFrame) -> DataFrame:
    """One row per (source, type, minute, status).

    Source, sid, protocol and texts come from the earliest alert; destination and features from the latest
    (of equal times, the earlier one). Every aggregate has a fixed-size state and combines before the shuffle;
    the member ids, which may be any number, are in ``group_member_ids``.
    """
    earliest = F.struct("ts", "id")
    latest = F.struct((-F.unix_micros("ts")).alias("newest"), "id")
    first = F.struct(
        S.text_or(F.col("source"), "unknown").alias("source"),
        "sid",
        "protocol",
        "ignore_justification",
        "resolve_justification",
    )
    last = F.struct("dst_ip", "dst_port", "model_features")
    return (
        _keyed(alerts)
        .groupBy(*GROUP_KEY)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.greatest(F.max("_score"), F.lit(0.0)).alias("max_score"),
            F.max("ts").alias("latest_ts"),
            F.min_by(first, earliest).alias("_first"),
            F.min_by(last, latest).alias("_last"),
        )
        .select(*GROUP_KEY, "count", "max_score", "latest_ts", "_first.*", "_last.*")
    )


def group_members(alerts: DataFrame) -> DataFrame:
    """One row per alert with the key of its group, its time and id: the members of a group, in order of (ts, id).

    Nothing is gathered, so a group may have any number of members.
    """
    return _keyed(alerts).select(*GROUP_KEY, "ts", "id")


def group_member_ids(alerts: DataFrame, slice_us: int = 1_000_000) -> DataFrame:
    """Ids of every group in time order, one array per time slice of the minute.

    Concatenating a group's slices in order gives all its ids; slices keep a very large group out of one row.
    """
    within = F.unix_micros("ts") - F.unix_micros(S.minute_floor(F.col("ts")))
    members = F.sort_array(F.collect_list(F.struct("ts", "id")))
    return (
        _keyed(alerts)
        .groupBy(*GROUP_KEY, F.floor(within / slice_us).cast("int").alias("slice"))
        .agg(F.transform(members, lambda m: m["id"]).alias("ids"))
    )


def group_pending_alerts(alerts: DataFrame) -> DataFrame:
    """Pending alerts per (source, type, minute)."""
    keyed = _keyed(alerts).where(F.col("status") == "pending")
    return keyed.groupBy("src_ip", "type", "window").agg(
        F.count(F.lit(1)).alias("count"),
        F.greatest(F.max("_score"), F.lit(0.0)).alias("max_score"),
        F.max("ts").alias("latest_ts"),
    )


def status_counts(alerts: DataFrame) -> DataFrame:
    status = status_of(alerts)
    return alerts.agg(
        *[F.count_if(status == s).alias(s) for s in ("pending", "ignored", "resolved")], F.count(F.lit(1)).alias("total")
    )


def count_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def count_by_severity(rows: DataFrame, score: str = "score") -> DataFrame:
    """All four severities, also those that do not occur, in one aggregation."""
    severity = L.severity4(F.coalesce(F.col(score), F.lit(0.0)))
    names = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    one = rows.agg(*[F.count_if(severity == s).alias(s) for s in names])
    return one.select(F.stack(F.lit(len(names)), *[c for s in names for c in (F.lit(s), F.col(s))]).alias("severity", "n"))


def severity_of_groups(groups: DataFrame) -> DataFrame:
    return count_by_severity(groups, "max_score")


def alert_timeline(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts of the last 48 hours per label: minutes for the last two hours, else hours; plus the true bucket."""
    age = S.age_hours(F.col("ts"), as_of)
    recent = age <= 2
    label = F.when(recent, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "dd/MM HH:00"))
    bucket = F.when(recent, S.minute_floor(F.col("ts"))).otherwise(F.date_trunc("hour", "ts"))
    return (
        alerts.where(F.col("ts").isNotNull() & (age <= 48))
        .groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(bucket).alias("bucket"))
    )


def layer_mapping(alerts: DataFrame) -> DataFrame:
    """Network layers and whether any alert type (lower-cased) or source contains one of their keywords."""
    seen = alerts.select(
        F.lower(F.coalesce("type", F.lit("unknown"))).alias("t"), F.coalesce("source", F.lit("unknown")).alias("s")
    ).distinct()

    def any_keyword(words: list[str]) -> Column:
        tests = [F.contains("t", F.lit(w)) | F.contains("s", F.lit(w)) for w in words]
        return F.coalesce(F.bool_or(reduce(lambda a, b: a | b, tests, F.lit(False))), F.lit(False))

    hits = seen.agg(*[any_keyword(words).alias(f"l{layer}") for layer, _, _, words in LAYERS])
    rows = [
        F.struct(
            F.lit(layer).alias("layer"),
            F.lit(name).alias("name"),
            F.array(*[F.lit(a) for a in attacks]).cast("array<string>").alias("attacks"),
            F.col(f"l{layer}").alias("hit"),
        )
        for layer, name, attacks, _ in LAYERS
    ]
    return hits.select(F.inline(F.array(*rows)))


def page(groups: DataFrame, limit: int | None = None, after: Row | None = None) -> DataFrame:
    """Groups, newest first; with ``limit`` a page of them.

    ``after`` is the last row of the page before (latest_ts and the group key), so that all pages together hold all
    groups, whatever arrives meanwhile.
    """
    if after is not None:
        same = F.col("latest_ts") == F.lit(after["latest_ts"])
        key = F.struct(*GROUP_ORDER)
        last = F.struct(*[F.lit(after[c]).alias(c) for c in GROUP_ORDER])
        groups = groups.where((F.col("latest_ts") < F.lit(after["latest_ts"])) | (same & (key > last)))
    rows = groups.orderBy(F.desc("latest_ts"), *GROUP_ORDER)
    return rows if limit is None else rows.limit(limit)


def placed(ordered: DataFrame) -> DataFrame:
    """Add ``place`` = 1, 2, ... to rows in their order: rows are counted by partition, no task sees all of them."""
    row = F.monotonically_increasing_id()
    rows = materialize(ordered.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND((1 << 33) - 1)}), "ordered")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    return rows.join(before.select("_part", "_before"), "_part").select(
        *ordered.columns, (F.col("_before") + F.col("_row") + 1).alias("place")
    )


def by_score(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("max_score"), *GROUP_ORDER)


def by_count(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("count"), *GROUP_ORDER)


def live_feed(groups: DataFrame, size: int = 12) -> DataFrame:
    return page(groups, size).withColumn("severity", L.severity4(F.col("max_score")))


def top_types(alerts: DataFrame, size: int = 10) -> DataFrame:
    return count_by(alerts, "type").orderBy(F.desc("n"), "type").limit(size)


def view_filter(groups: DataFrame, view: str = "alerts", source: str = "", severity: str = "") -> DataFrame:
    """Groups of one view (alerts, resolved, ignored), optionally of one source and severity."""
    wanted = {"alerts": "pending", "resolved": "resolved", "ignored": "ignored"}.get(view)
    out = groups
    if wanted:
        out = out.where(S.text_or(F.col("status"), "pending") == wanted)
    if source:
        out = out.where(F.col("source") == source)
    if severity:
        out = out.where(L.severity4(F.col("max_score")) == severity)
    return out


def window_text(window: Column) -> Column:
    return F.date_format(window, "yyyy-MM-dd'T'HH:mm:ssxxx")


def alert_search(groups: DataFrame, query: str) -> DataFrame:
    """Case-insensitive text search over the visible columns of a group."""
    if not query:
        return groups
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("src_ip", "dst_ip", "type", "source", "sid")]
    text = F.lower(F.concat_ws(" ", *fields, F.coalesce(window_text(F.col("window")), F.lit(""))))
    return groups.where(F.contains(text, F.lit(query.lower())))


def latest_detection_per_ip(alerts: DataFrame) -> DataFrame:
    """Newest signature alert of every source address."""
    newest = F.struct((-F.unix_micros("ts")).alias("newest"), "id")
    body = F.struct(F.col("type").alias("reason"), S.text_or(F.col("source"), "builtin").alias("source_engine"), "ts")
    return (
        signature_alerts(alerts)
        .where(F.coalesce("src_ip", F.lit("")) != "")
        .groupBy("src_ip")
        .agg(F.min_by(body, newest).alias("_row"))
        .select("src_ip", "_row.*", F.lit("detect-only").alias("mode"))
    )


def distinct_blocks(block_log: DataFrame) -> DataFrame:
    """First block-log row of every source address."""
    body = F.struct("reason", "ts", "mode")
    return (
        block_log.where(F.coalesce("src_ip", F.lit("")) != "")
        .groupBy("src_ip")
        .agg(F.min_by(body, F.struct("ts", "reason")).alias("_row"))
        .select("src_ip", "_row.*")
    )


def blocked_or_detected(block_log: DataFrame, alerts: DataFrame) -> DataFrame:
    """The block list; if nothing was ever blocked, the latest detection per source instead."""
    columns = ["src_ip", "reason", "source_engine", "ts", "mode"]
    blocks = distinct_blocks(block_log).withColumn("source_engine", F.lit(None).cast("string"))
    anything = block_log.where(F.coalesce("src_ip", F.lit("")) != "").limit(1).agg(F.count(F.lit(1)))
    fallback = latest_detection_per_ip(alerts).where(anything.scalar() == 0)
    return blocks.select(*columns).unionByName(fallback.select(*columns))
