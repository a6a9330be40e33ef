"""Catalogue queries over the alert store: groups, displays, analytics, decisions and scalar helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators import alerts as A
from flowsentry.operators import cascade, decisions, intel
from flowsentry.plans import inputs as I
from flowsentry.plans import oracle as O
from flowsentry.plans.catalog import Catalog
from flowsentry.plans.detection import full_cascade
from flowsentry.session import materialize
from flowsentry.sources import readers, sinks

AS_OF_US = 8_400_000_000

_STORES: dict[tuple[str, str, str], DataFrame] = {}


def alert_store(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts of the whole packet table, kept as a written table as long as its input files stay as they are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    version = ",".join(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found)
    key = (spark.sparkContext.applicationId, sf, version)
    if key not in _STORES:
        _STORES[key] = materialize(full_cascade(spark, sf), "alerts")
    return _STORES[key]


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Stored alerts after one decision per fourth alert."""
    store = alert_store(spark, sf)
    return decisions.apply_decisions(store, decisions.validate_decisions(decision_requests(spark, sf)))


def decision_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests derived from the stored alerts, valid and invalid ones."""
    n = F.col("event_id")
    status = F.when(n % 4 == 0, "ignored").when(n % 4 == 1, " Resolved ").when(n % 4 == 2, "pending").otherwise("closed")
    text = F.when(n % 3 == 0, F.concat(F.lit("  <b>checked</b> "), F.col("src_ip"))).when(n % 3 == 1, F.lit(""))
    return alert_store(spark, sf).select(
        F.array(F.col("id"), F.lit("no-uuid"), F.concat(F.lit(" "), F.upper("id"))).alias("ids"),
        status.alias("new_status"),
        text.alias("justification"),
        F.timestamp_micros(F.lit(AS_OF_US) + n).alias("decision_ts"),
    )


DECIDED_SQL = O.chain(
    O.PACKETS, O.FEATURES, O.SERVICES, O.SYN, O.LOGIN, O.REGION_RULES, O.RULE_HITS, O.ALERTS,
    """decided as (select *, case when event_id % 4 = 0 then 'ignored' when event_id % 4 = 1 then 'resolved' else 'pending' end as status,
      case when event_id % 3 = 0 then 'checked ' || src_ip else '' end as txt, event_id % 4 < 3 as changed from alerts),
    overlaid as (select *, case when status = 'ignored' and txt <> '' then txt end as ignore_justification,
      case when status in ('resolved', 'pending') and changed and txt <> '' then txt end as resolve_justification from decided),
    placed as (select *, t_us // 60000000 * 60000000 as window_us,
      row_number() over (partition by src_ip, type, status, t_us // 60000000 order by t_us, id) as from_start,
      row_number() over (partition by src_ip, type, status, t_us // 60000000 order by t_us desc, id) as from_end from overlaid),
    groups as (select src_ip, type, window_us, status, count(*) as count, max(score) as max_score, max(t_us) as latest_us,
      max(case when from_start = 1 then source end) as source, max(case when from_start = 1 then sid end) as sid,
      max(case when from_start = 1 then protocol end) as protocol,
      max(case when from_start = 1 then ignore_justification end) as ignore_justification,
      max(case when from_start = 1 then resolve_justification end) as resolve_justification,
      max(case when from_end = 1 then dst_ip end) as dst_ip, max(case when from_end = 1 then dst_port end) as dst_port,
      max(case when from_end = 1 then total_bytes end) as total_bytes from placed group by 1, 2, 3, 4)""",
)
GROUP_OUT = (
    "src_ip type window_us status count max_score latest_us source sid protocol ignore_justification resolve_justification "
    "dst_ip dst_port"
).split()
GROUP_SQL = ", ".join(GROUP_OUT)
SHOWN = ["src_ip", "type", "window_us", "status", "count", "max_score", "latest_us"]
SHOWN_SQL = ", ".join(SHOWN)
TIES = "src_ip, type, window_us, status"


def shown(groups: DataFrame, columns: list[str] = SHOWN) -> DataFrame:
    return groups.withColumns(
        {"window_us": F.unix_micros("window"), "latest_us": F.unix_micros("latest_ts")}
    ).select(*columns)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_alerts(decided(spark, sf))


def block_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = cascade.block_rows(alert_store(spark, sf), "block-signature")
    return rows.withColumn("ts", F.timestamp_micros("t_us"))


BLOCKS_SQL = """blocks as (select src_ip, t_us, event_id, substr(type, 11) as reason from alerts where type like 'signature:%'
  qualify row_number() over (partition by src_ip order by t_us, event_id) = 1)"""
DETECTED_SQL = """detected as (select src_ip, t_us, type as reason, source as source_engine from alerts
  where source in ('snort', 'suricata', 'otx', 'builtin') or type like 'signature:%'
  qualify row_number() over (partition by src_ip order by t_us desc, id) = 1)"""
ALERTS_AND = O.WITH_ALERTS.rstrip() + ",\n"


def register(c: Catalog) -> None:
    @c.add("agg1_group_alerts_by_status", DECIDED_SQL + f"select {GROUP_SQL}, total_bytes from groups")
    def agg1(spark, sf):
        rows = groups(spark, sf).withColumn("total_bytes", F.col("model_features.total_bytes"))
        return shown(rows, [*GROUP_OUT, "total_bytes"])

    @c.add("agg1_group_members", DECIDED_SQL + "select src_ip, type, window_us, status, t_us, id from placed")
    def agg1_members(spark, sf):
        members = A.group_members(decided(spark, sf))
        return members.select(
            "src_ip", "type", F.unix_micros("window").alias("window_us"), "status", F.unix_micros("ts").alias("t_us"), "id"
        )

    @c.add(
        "agg1_group_member_ids",
        DECIDED_SQL
        + """select src_ip, type, window_us, status, cast(t_us % 60000000 // 1000000 as integer) as slice,
             string_agg(id, ',' order by t_us, id) as ids from placed group by 1, 2, 3, 4, 5""",
    )
    def agg1_ids(spark, sf):
        ids = A.group_member_ids(decided(spark, sf))
        return ids.select(
            "src_ip", "type", F.unix_micros("window").alias("window_us"), "status", "slice", F.array_join("ids", ",").alias("ids")
        )

    @c.add(
        "agg2_group_pending_alerts",
        DECIDED_SQL
        + """select src_ip, type, window_us, count(*) as count, max(score) as max_score, max(t_us) as latest_us
             from placed where status = 'pending' group by 1, 2, 3""",
    )
    def agg2(spark, sf):
        pending = A.group_pending_alerts(decided(spark, sf))
        return shown(pending, ["src_ip", "type", "window_us", "count", "max_score", "latest_us"])

    @c.add(
        "agg3_status_counts",
        DECIDED_SQL
        + """select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'ignored') as ignored,
             count(*) filter (status = 'resolved') as resolved, count(*) as total from decided""",
    )
    def agg3(spark, sf):
        return A.status_counts(decided(spark, sf))

    for name, column in (("agg4_count_by_type", "type"), ("agg5_count_by_source", "source")):
        c.add(name, O.WITH_ALERTS + f"select {column}, count(*) as n from alerts group by 1")(
            lambda spark, sf, column=column: A.count_by(alert_store(spark, sf), column)
        )

    levels = "(values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity)"

    @c.add(
        "agg6_count_by_severity",
        O.WITH_ALERTS
        + f"select severity, count(event_id) as n from {levels} left join alerts on {O.severity('score')} = severity group by 1",
    )
    def agg6(spark, sf):
        return A.count_by_severity(alert_store(spark, sf))

    @c.add(
        "agg7_alert_timeline",
        O.WITH_ALERTS
        + f"""select label, count(*) as count, min(bucket) as bucket_us from (select
              case when age <= 7200000000 then strftime(make_timestamp(t_us), '%H:%M')
                else strftime(make_timestamp(t_us), '%d/%m %H:00') end as label,
              case when age <= 7200000000 then t_us // 60000000 * 60000000 else t_us // 3600000000 * 3600000000 end as bucket
              from (select *, {AS_OF_US} - t_us as age from alerts) where age <= 172800000000) group by 1""",
    )
    def agg7(spark, sf):
        rows = A.alert_timeline(alert_store(spark, sf), F.timestamp_micros(F.lit(AS_OF_US)))
        return rows.select("label", "count", F.unix_micros("bucket").alias("bucket_us"))

    @c.add(
        "agg8_severity_of_groups",
        DECIDED_SQL
        + f"select severity, count(src_ip) as n from {levels} left join groups on {O.severity('max_score')} = severity group by 1",
    )
    def agg8(spark, sf):
        return A.severity_of_groups(groups(spark, sf))

    @c.add(
        "win6_first_block_per_ip",
        ALERTS_AND + BLOCKS_SQL + " select src_ip, t_us, event_id, reason, 'block-signature' as mode from blocks",
    )
    def win6(spark, sf):
        return cascade.block_rows(alert_store(spark, sf), "block-signature")

    @c.add("win7_latest_detection_per_ip", ALERTS_AND + DETECTED_SQL + " select * from detected")
    def win7(spark, sf):
        rows = A.latest_detection_per_ip(alert_store(spark, sf))
        return rows.select("src_ip", F.unix_micros("ts").alias("t_us"), "reason", "source_engine")

    @c.add(
        "join7_blocked_or_detected",
        ALERTS_AND + BLOCKS_SQL + ", " + DETECTED_SQL
        + """ select 'blocked' as shown, src_ip, reason, null::varchar as source_engine, t_us, 'block-signature' as mode from blocks
            union all select 'detected', src_ip, reason, source_engine, t_us, 'detect-only' from detected""",
    )
    def join7(spark, sf):
        store, log = alert_store(spark, sf), block_log(spark, sf)
        blocked = A.blocked_or_detected(log, store).select(F.lit("blocked").alias("shown"), "*")
        nothing = log.where(F.col("mode") == "detect-only")
        detected = A.blocked_or_detected(nothing, store).select(F.lit("detected").alias("shown"), "*")
        return blocked.unionByName(detected).withColumn("t_us", F.unix_micros("ts")).drop("ts")

    @c.add(
        "srt5_block_list",
        ALERTS_AND + BLOCKS_SQL + " select src_ip, t_us, reason from blocks order by t_us desc, src_ip",
    )
    def srt5(spark, sf):
        rows = block_log(spark, sf).select("src_ip", "t_us", "reason")
        return intel.listed(rows, [F.desc("t_us"), F.col("src_ip")])

    @c.add(
        "join6_layer_mapping",
        O.WITH_ALERTS + f""", layers(layer, name, keywords) as (values {LAYERS_SQL})
        select layer, name, (select count(*) > 0 from alerts a, unnest(keywords) k(word)
          where contains(lower(a.type), word) or contains(a.source, word)) as hit from layers""",
    )
    def join6(spark, sf):
        return A.layer_mapping(alert_store(spark, sf)).select("layer", "name", "hit")

    @c.add("srt1_groups_newest_first", DECIDED_SQL + f"select {SHOWN_SQL} from groups order by latest_us desc, {TIES}")
    def srt1(spark, sf):
        return shown(A.page(groups(spark, sf)))

    def place(first: str) -> str:
        return f"select {SHOWN_SQL}, row_number() over (order by {first} desc, {TIES}) as place from groups"

    @c.add("srt2_groups_by_score", DECIDED_SQL + place("max_score"))
    def srt2_score(spark, sf):
        return shown(A.placed(A.by_score(groups(spark, sf))), [*SHOWN, "place"])

    @c.add("srt2_groups_by_count", DECIDED_SQL + place("count"))
    def srt2_count(spark, sf):
        return shown(A.placed(A.by_count(groups(spark, sf))), [*SHOWN, "place"])

    @c.add(
        "srt3_live_feed",
        DECIDED_SQL + f"select {SHOWN_SQL}, {O.severity('max_score')} as severity from groups order by latest_us desc, {TIES} limit 12",
    )
    def srt3(spark, sf):
        return shown(A.live_feed(groups(spark, sf)), [*SHOWN, "severity"])

    @c.add("srt4_top_types", O.WITH_ALERTS + "select type, count(*) as n from alerts group by 1 order by n desc, type limit 10")
    def srt4(spark, sf):
        return A.top_types(alert_store(spark, sf))

    @c.add(
        "flt1_view_filter",
        DECIDED_SQL + f"select {SHOWN_SQL} from groups where status = 'resolved' and source = 'otx' and max_score >= 0.95::double",
    )
    def flt1(spark, sf):
        return shown(A.view_filter(groups(spark, sf), "resolved", "otx", "CRITICAL"))

    @c.add(
        "flt2_alert_search",
        DECIDED_SQL
        + f"""select {SHOWN_SQL} from groups where contains(lower(concat_ws(' ', src_ip, dst_ip, type, source, coalesce(sid, ''),
              strftime(make_timestamp(window_us), '%Y-%m-%dT%H:%M:%S+00:00'))), 'ssh')""",
    )
    def flt2(spark, sf):
        return shown(A.alert_search(groups(spark, sf), "SSH"))

    @c.add(
        "flt5_signature_alerts",
        O.WITH_ALERTS
        + "select event_id, id from alerts where source in ('snort', 'suricata', 'otx', 'builtin') or type like 'signature:%'",
    )
    def flt5(spark, sf):
        return cascade.signature_alerts(alert_store(spark, sf)).select("event_id", "id")

    @c.add(
        "flt4_decision_validate",
        DECIDED_SQL
        + """select u.id, status as new_status, txt as justification, event_id + 8400000000 as decision_us
             from decided, unnest([id, upper(id)]) u(id) where changed""",
    )
    def flt4(spark, sf):
        rows = decisions.validate_decisions(decision_requests(spark, sf))
        return rows.select("id", "new_status", "justification", F.unix_micros("decision_ts").alias("decision_us"))

    @c.add(
        "join5_apply_decisions",
        DECIDED_SQL + "select id, status, changed, ignore_justification, resolve_justification from overlaid",
    )
    def join5(spark, sf):
        return decided(spark, sf).select("id", "status", "changed", "ignore_justification", "resolve_justification")

    @c.add(
        "snk4_append_feedback",
        DECIDED_SQL
        + """select id as alert_id, status as decision, type, total_bytes, nullif(txt, '') as justification
             from decided where status in ('ignored', 'resolved')""",
    )
    def snk4(spark, sf):
        from flowsentry.session import scratch_path

        path = scratch_path(spark, "feedback")
        sinks.append_feedback(decided(spark, sf), path)
        rows = readers.read_feedback(spark, path)
        size = F.try_element_at("alert.model_features", F.lit("total_bytes")).cast("double")
        return rows.select("alert_id", "decision", "alert.type", size.alias("total_bytes"), "justification")

    @c.add("snk5_write_status_overlay", DECIDED_SQL + "select id, status from decided")
    def snk5(spark, sf):
        from flowsentry.session import scratch_path

        path = scratch_path(spark, "decisions")
        store = alert_store(spark, sf)
        sinks.append_alerts(store, f"{path}/alerts")
        sinks.append_decisions(decision_requests(spark, sf), f"{path}/decisions")
        return readers.read_current_alerts(spark, f"{path}/alerts", f"{path}/decisions").select("id", "status")

    @c.add("prj11_severity4", O.WITH_ALERTS + f"select event_id, {O.severity('score')} as severity from alerts")
    def prj11(spark, sf):
        return alert_store(spark, sf).select("event_id", L.severity4(F.col("score")).alias("severity"))

    @c.add(
        "prj12_priority3",
        O.WITH_ALERTS
        + """select event_id, case when score >= 0.85::double then 'HIGH' when score >= 0.6::double then 'MEDIUM' else 'LOW' end
             as priority from alerts""",
    )
    def prj12(spark, sf):
        return alert_store(spark, sf).select("event_id", L.priority3(F.col("score")).alias("priority"))

    @c.add(
        "prj15_private_ip_flag",
        O.WITH_PACKETS
        + """select event_id, ip, split_part(ip, '.', 1) = '10' or (split_part(ip, '.', 1) = '192' and split_part(ip, '.', 2) = '168')
             or (split_part(ip, '.', 1) = '172' and cast(split_part(ip, '.', 2) as int) between 16 and 31) as private
             from (select event_id, (['10.0.0.', '172.16.1.', '172.32.0.', '192.168.4.', '192.169.1.', '8.8.8.'])[event_id % 6 + 1]
               || cast(event_id % 200 as varchar) as ip from packets)""",
    )
    def prj15(spark, sf):
        nets = F.array(*[F.lit(n) for n in ("10.0.0.", "172.16.1.", "172.32.0.", "192.168.4.", "192.169.1.", "8.8.8.")])
        n = F.col("event_id")
        ip = F.concat(F.element_at(nets, (n % 6 + 1).cast("int")), (n % 200).cast("string"))
        return I.packets(spark, sf).select(n, ip.alias("ip")).withColumn("private", S.private_ip(F.col("ip")))

    @c.add(
        "prj16_attack_class_hint",
        O.WITH_ALERTS
        + """select event_id, case when regexp_matches(t, 'syn|flood|ddos') then 'DDoS / SYN Flood'
              when regexp_matches(t, 'brute|ssh|telnet|rdp') then 'Brute Force / Credential Attack'
              when regexp_matches(t, 'scan|recon') then 'Port Scan / Reconnaissance'
              when regexp_matches(t, 'otx|ioc|malware|c2') then 'Malware / C2 Communication' else '' end as hint
             from (select event_id, lower(type) as t from alerts)""",
    )
    def prj16(spark, sf):
        return alert_store(spark, sf).select("event_id", L.attack_class_hint(F.col("type")).alias("hint"))

    @c.add(
        "prj17_justification_text",
        O.WITH_ALERTS
        + """select event_id, regexp_replace(substr(case when preset in ('', 'other') then coalesce(nullif(notes, ''), fallback)
               when notes = '' then preset else preset || ' — ' || notes end, 1, 500), '<[^>]+>', '', 'g') as txt
             from (select event_id, (['', 'other', 'Port Scan / Reconnaissance'])[event_id % 3 + 1] as preset,
               case when event_id % 2 = 0 then '' else repeat('<i>seen</i> on ' || src_ip || ' ', 1 + cast(event_id % 30 as int))
                 || 'end' end as notes,
               case when event_id % 5 < 2 then 'No justification provided' else 'Confirmed threat' end as fallback from alerts)""",
    )
    def prj17(spark, sf):
        n = F.col("event_id")
        preset = F.when(n % 3 == 0, "").when(n % 3 == 1, "other").otherwise("Port Scan / Reconnaissance")
        seen = F.concat(F.lit("<i>seen</i> on "), F.col("src_ip"), F.lit(" "))
        notes = F.when(n % 2 == 0, "  ").otherwise(F.concat(F.repeat(seen, (1 + n % 30).cast("int")), F.lit("end ")))
        decision = F.when(n % 5 < 2, "ignored").otherwise("resolved")
        return alert_store(spark, sf).select(n, L.justification_text(preset, notes, decision).alias("txt"))

    @c.add(
        "prj18_chart_label",
        O.WITH_ALERTS + "select event_id, substr(replace(type, 'signature:', ''), 1, 28) as label from alerts",
    )
    def prj18(spark, sf):
        return alert_store(spark, sf).select("event_id", L.chart_label(F.col("type")).alias("label"))

    @c.add(
        "prj19_alert_iso_ts",
        O.WITH_ALERTS
        + f"""select event_id, case event_id % 4 when 0 then t_us when 1 then t_us - 25200000000 else {AS_OF_US} end as ts_us
              from alerts""",
    )
    def prj19(spark, sf):
        n = F.col("event_id")
        plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = (
            F.when(n % 4 == 0, F.concat(plain, F.lit("Z")))
            .when(n % 4 == 1, F.concat(plain, F.lit("+07:00")))
            .when(n % 4 == 2, F.lit(""))
            .otherwise(F.concat(F.lit("on "), plain))
        )
        parsed = S.parse_iso(text, F.timestamp_micros(F.lit(AS_OF_US)))
        return alert_store(spark, sf).select(n, F.unix_micros(parsed).alias("ts_us"))


LAYERS_SQL = ", ".join(
    f"({layer}, '{name}', [{', '.join(repr(w) for w in words)}]::varchar[])" for layer, name, _, words in A.LAYERS
)
