"""Catalogue queries over packets: fields, features, detectors, rules and the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators import cascade, cooldown, flows, intel, rules as rule_ops, thresholds
from flowsentry.plans import inputs as I
from flowsentry.plans import oracle as O
from flowsentry.plans.catalog import Catalog

ROUNDED = ["duration", "avg_pkt_size", "pkts_per_sec", "bytes_per_sec"]
ROUNDED_SQL = ", ".join(f"round({c}, 6) as {c}" for c in ROUNDED)
FLOW_SQL = "src_ip, dst_ip, src_port, dst_port, proto"

#: SQL view of the JSON-shaped events and their normalised fields.
RAW_SQL = """raw as (select event_id, t_us,
  case when event_id % 2 = 0 or event_id % 2 = 1 then src_ip end as src_ip,
  case when event_id % 3 in (0, 1) then dst_ip else '0.0.0.0' end as dst_ip, src_port,
  case when event_id % 11 <> 0 then dst_port else 0 end as dst_port, proto, flags, packet_size,
  case when event_id % 7 = 0 then cast(event_id % 4 as double) else 0 end as in_pkts,
  case when event_id % 7 = 0 then cast(event_id % 3 as double) else 0 end as out_pkts,
  case when event_id % 7 = 0 and event_id % 5 <> 0 then packet_size * 2.0::double else packet_size end as in_bytes,
  case when event_id % 7 = 0 then cast(event_id % 100 as double) else 0 end as out_bytes,
  case when event_id % 7 = 0 then cast(event_id % 50 as double) else 0 end as duration_ms from packets)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED if c in df.columns})


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return intel.ioc_match(I.packets(spark, sf), I.indicators(spark, sf))


def syn_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = flagged(spark, sf).where(~F.col("ioc"))
    return thresholds.syn_only(rows).select("event_id", "t_us", "src_ip", "dst_port")


def login_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = syn_rows(spark, sf)
    return cascade.without_events(rows, thresholds.syn_flood(rows))


def heuristic_alerts(spark: SparkSession, sf: str) -> DataFrame:
    scored = cascade.heuristic_scorer(flows.flow_features(I.packets(spark, sf)))
    return scored.withColumn("anomaly", L.anomaly_label(F.col("ml"), 0.75))


def full_cascade(spark: SparkSession, sf: str, mode: str = "detect-only") -> DataFrame:
    config = cascade.CascadeConfig(mode=mode)
    return cascade.run_cascade(I.packets(spark, sf), I.indicators(spark, sf), I.cascade_rules(spark, sf), config)


ALERT_OUT = ["event_id", "id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "type", "score", "source", "sid",
             "ml_score", "hybrid_confirmed"]


def register(c: Catalog) -> None:
    @c.add(
        "anomaly_minutes",
        O.WITH_FEATURES
        + """select src_ip, t_us // 60000000 * 60000000 as minute_us, 'xgboost_anomaly' as type, count(*) as n,
             max(ml) as max_score, max(t_us) as latest_us from scored where ml >= 0.75::double
             group by 1, 2 order by latest_us desc, src_ip""",
    )
    def anomaly_minutes(spark, sf):
        hits = heuristic_alerts(spark, sf).where(F.col("anomaly") != "benign")
        minute = F.unix_micros(S.minute_floor(F.timestamp_micros("t_us")))
        return (
            hits.groupBy("src_ip", minute.alias("minute_us"), F.col("anomaly").alias("type"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("ml").alias("max_score"), F.max("t_us").alias("latest_us"))
            .orderBy(F.desc("latest_us"), "src_ip")
        )

    @c.add("prj1_event_fields", O.chain(O.PACKETS, RAW_SQL) + "select * from raw")
    def prj1(spark, sf):
        return flows.event_fields(I.raw_events(spark, sf))

    @c.add(
        "prj2_flow_record_features",
        O.chain(O.PACKETS, RAW_SQL)
        + """select event_id, greatest(in_pkts + out_pkts, 1) as total_frames, greatest(in_bytes + out_bytes, 0) as total_bytes,
             round(d, 6) as duration, round((in_bytes + out_bytes) / greatest(in_pkts + out_pkts, 1), 6) as avg_pkt_size,
             round(greatest(in_pkts + out_pkts, 1) / d, 6) as pkts_per_sec, round((in_bytes + out_bytes) / d, 6) as bytes_per_sec
             from (select *, greatest(duration_ms / 1000.0::double, 0.001::double) as d from raw
                   where in_pkts > 0 or out_pkts > 0)""",
    )
    def prj2(spark, sf):
        events = flows.event_fields(I.raw_events(spark, sf)).where("in_pkts > 0 or out_pkts > 0")
        return rounded(flows.flow_record_features(events).select("event_id", "total_frames", "total_bytes", *ROUNDED))

    @c.add(
        "prj3_protocol_code",
        O.WITH_PACKETS
        + """select event_id, (case event_id % 5 when 0 then 1 when 1 then 0 else 6 end)::integer as every_kind,
             case proto when 'TCP' then 6 when 'UDP' then 17 else 0 end as code from packets""",
    )
    def prj3(spark, sf):
        n = F.col("event_id") % 5
        kind = F.when(n == 0, "ICMP").when(n == 1, "icmp").otherwise("TCP")
        return I.packets(spark, sf).select(
            "event_id", S.protocol_code(kind).alias("every_kind"), S.protocol_code(F.col("proto")).alias("code")
        )

    @c.add(
        "prj4_tcp_flags_mask",
        O.WITH_PACKETS
        + """select event_id, case flags when 'S' then 2 when 'SA' then 18 else 0 end as mask,
             cast(event_id % 256 as integer) as every_mask from packets""",
    )
    def prj4(spark, sf):
        letters = [F.when(F.col("event_id").bitwiseAND(bit) != 0, F.lit(letter)) for letter, bit in S.FLAG_BITS.items()]
        # Letters in any order, some of them twice, and one that means nothing.
        text = F.concat(F.reverse(F.concat_ws("", *letters)), F.lit("x"), F.concat_ws("", *letters[::3]))
        return I.packets(spark, sf).select(
            "event_id", S.tcp_flags_mask(F.col("flags")).alias("mask"), S.tcp_flags_mask(text).alias("every_mask")
        )

    @c.add("prj6_heuristic_score", O.WITH_FEATURES + "select event_id, round(ml, 6) as score from scored")
    def prj6(spark, sf):
        return heuristic_alerts(spark, sf).select("event_id", F.round("ml", 6).alias("score"))

    @c.add(
        "prj7_anomaly_label",
        O.WITH_FEATURES
        + """select case when ml >= 0.75::double then 'xgboost_anomaly' else 'benign' end as label, count(*) as n
             from scored group by 1""",
    )
    def prj7(spark, sf):
        return heuristic_alerts(spark, sf).groupBy(F.col("anomaly").alias("label")).agg(F.count(F.lit(1)).alias("n"))

    @c.add(
        "flt6_syn_only", O.WITH_PACKETS + "select event_id, src_ip, t_us from packets where proto = 'TCP' and flags = 'S'"
    )
    def flt6(spark, sf):
        return thresholds.syn_only(I.packets(spark, sf)).select("event_id", "src_ip", "t_us")

    @c.add("join1_ioc_match", O.WITH_SYN + "select event_id, ioc from flagged")
    def join1(spark, sf):
        return flagged(spark, sf).select("event_id", "ioc")

    @c.add(
        "join4_service_lookup",
        O.WITH_SYN + "select event_id, dst_port, service, attempts, window_us, cooldown_us from packets join services using (dst_port)",
    )
    def join4(spark, sf):
        rows = thresholds.service_lookup(I.packets(spark, sf))
        return rows.select("event_id", "dst_port", "service", "attempts", "window_us", "cooldown_us")

    features_sql = f"select event_id, session_start_us, total_frames, total_bytes, {ROUNDED_SQL} from features"

    @c.add("win1_running_flow_features", O.WITH_FEATURES + features_sql)
    def win1(spark, sf):
        out = flows.running_flow_features(I.packets(spark, sf))
        return rounded(out.select("event_id", "session_start_us", "total_frames", "total_bytes", *ROUNDED))

    @c.add(
        "win2_flow_sessions",
        O.WITH_FEATURES
        + f"select {FLOW_SQL}, session_start_us, event_id from features",
    )
    def win2(spark, sf):
        return flows.running_flows(I.packets(spark, sf)).select(*flows.FLOW_KEY, "session_start_us", "event_id")

    @c.add(
        "agg10_flow_summary",
        O.WITH_FEATURES
        + f"""select {FLOW_SQL}, session_start_us, last_us, total_frames, total_bytes, round(d, 6) as duration,
              round(total_bytes / total_frames, 6) as avg_pkt_size, round(total_frames / d, 6) as pkts_per_sec,
              round(total_bytes / d, 6) as bytes_per_sec from (select *,
               greatest((last_us - session_start_us) / 1000000.0::double, 0.001::double) as d from (
               select {FLOW_SQL}, min(t_us) as session_start_us, max(t_us) as last_us, cast(count(*) as double) as total_frames,
                cast(sum(packet_size) as double) as total_bytes from sessions group by {FLOW_SQL}, session_no))""",
    )
    def agg10(spark, sf):
        return rounded(flows.flow_summary(I.packets(spark, sf)))

    @c.add("win3_syn_flood_candidates", O.WITH_SYN + "select src_ip, t_us, event_id from syn_cand")
    def win3_candidates(spark, sf):
        return thresholds.syn_flood_candidates(syn_rows(spark, sf)).select("src_ip", "t_us", "event_id")

    @c.add(
        "win3_syn_flood",
        O.WITH_SYN + "select src_ip, t_us, event_id, 'SYNFloodIndicator' as name, 0.96::double as severity from syn_hits",
    )
    def win3(spark, sf):
        return thresholds.syn_flood(syn_rows(spark, sf))

    @c.add(
        "win4_login_bruteforce",
        O.WITH_LOGIN + "select src_ip, dst_port, t_us, event_id, name, round(severity, 6) as severity from login_hits",
    )
    def win4(spark, sf):
        return thresholds.login_bruteforce(login_rows(spark, sf)).withColumn("severity", F.round("severity", 6))

    @c.add(
        "win5_alert_cooldown",
        O.chain(
            O.PACKETS,
            """cand as (select src_ip, dst_port, t_us, event_id from packets where proto = 'TCP'),
            times as (select src_ip, dst_port, min(t_us) as t_us from cand group by all
              union all select k.src_ip, k.dst_port, min(c.t_us) from times k join cand c on c.src_ip = k.src_ip
               and c.dst_port = k.dst_port and c.t_us >= k.t_us + 20000000 group by all)""",
        )
        + "select src_ip, dst_port, t_us, min(event_id) as event_id from cand join times using (src_ip, dst_port, t_us) group by all",
    )
    def win5(spark, sf):
        rows = I.packets(spark, sf).where("proto = 'TCP'").select("src_ip", "dst_port", "t_us", "event_id")
        return cooldown.keep_after_cooldown(rows, ["src_ip", "dst_port"], F.lit(20_000_000))

    @c.add(
        "join3_stage_exclusion",
        O.WITH_SYN + "select event_id, src_ip, dst_port from syn_rows where event_id not in (select event_id from syn_hits)",
    )
    def join3(spark, sf):
        return login_rows(spark, sf).select("event_id", "src_ip", "dst_port")

    @c.add(
        "join2_first_rule_match",
        O.chain(O.PACKETS, PARSED_SQL, PART_HITS_SQL)
        + "select event_id, name, severity, sid from part_hits",
    )
    def join2(spark, sf):
        matched = rule_ops.first_rule_match(I.packets(spark, sf), I.part_rules(spark, sf))
        return matched.where("rule is not null").select("event_id", "rule.name", "rule.severity", "rule.sid")

    @c.add("prj13_rule_parse", "with " + PARSED_SQL + " select line_no, name, sid, src_ip, dst_ip, dst_port, proto from parsed")
    def prj13(spark, sf):
        columns = ["name", "sid", "src_ip", "dst_ip", "dst_port", "proto"]
        return I.part_rules(spark, sf).select(F.col("ord.line").alias("line_no"), *columns)

    @c.add(
        "prj14_rule_severity",
        "with " + PARSED_SQL + """ select engine as source_engine, count(*) as n, 0.98::double as severity from parsed,
          (values ('snort'), ('suricata')) e(engine) group by 1""",
    )
    def prj14(spark, sf):
        both = I.part_rules(spark, sf).unionByName(I.part_rules(spark, sf, "suricata", 3))
        return both.groupBy("source_engine").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))

    @c.add(
        "set1_rule_union",
        "with " + O.REGION_RULES + ", " + PARSED_SQL
        + """ select tier, cast(line as bigint) as line, name, engine as source_engine from rules
          union all select t, line_no, name, case t when 2 then 'snort' else 'suricata' end from parsed, (values (2), (3)) x(t)""",
    )
    def set1(spark, sf):
        rules = rule_ops.rule_union(
            I.cascade_rules(spark, sf), I.part_rules(spark, sf), I.part_rules(spark, sf, "suricata", 3)
        )
        return rules.select("ord.tier", "ord.line", "name", "source_engine")

    alert_columns = ", ".join(ALERT_OUT)

    @c.add("prj8_alert_row", O.WITH_ALERTS + f"select {alert_columns} from alerts")
    def prj8(spark, sf):
        return full_cascade(spark, sf).select(*ALERT_OUT)

    @c.add(
        "prj9_hybrid_escalation",
        O.WITH_ALERTS + "select event_id, type, score, ml_score, hybrid_confirmed from alerts where type like '%L7BruteForce%'",
    )
    def prj9(spark, sf):
        alerts = full_cascade(spark, sf).where(F.contains("type", F.lit("L7BruteForce")))
        return alerts.select("event_id", "type", "score", "ml_score", "hybrid_confirmed")

    @c.add(
        "prj10_policy_action",
        O.WITH_ALERTS
        + """select mode, case when source <> 'ml' and mode = 'block-signature' then 'blocked'
              when source = 'ml' and mode = 'soc-queue-ml' then 'queued_soc' else 'detect' end as action, count(*) as n
             from alerts, (values ('detect-only'), ('block-signature'), ('soc-queue-ml')) m(mode) group by all""",
    )
    def prj10(spark, sf):
        alerts = full_cascade(spark, sf).select((F.col("source") != "ml").alias("sig"))
        modes = ["detect-only", "block-signature", "soc-queue-ml"]
        per_mode = [F.struct(F.lit(m).alias("mode"), L.policy_action(m, F.col("sig")).alias("action")) for m in modes]
        return alerts.select(F.inline(F.array(*per_mode))).groupBy("mode", "action").agg(F.count(F.lit(1)).alias("n"))


#: Rule text of the parts, split into tokens without the pattern the Spark side uses.
PARSED_SQL = r"""pick as (select p_partkey as k, p_name,
  (['alert','drop','reject','pass','log'])[k % 5 + 1] as action,
  (['tcp','udp','ip','http','icmp','tcp','udp'])[k % 7 + 1] as hp,
  (['any','10.0.0.1','$EXTERNAL_NET','10.0.0.11','10.0.0.0/8','!10.0.0.1','any','10.0.0.77'])[k % 8 + 1] as hs,
  (['->','->','->','->','->','->','->','->','<>'])[k % 9 + 1] as dir,
  (['192.168.1.1','any','192.168.1.3','[192.168.1.1,192.168.1.2]','192.168.1.9','192.168.1.0'])[k % 6 + 1] as hd,
  (['80','443','any','53','1:1024','[80,443]','$HTTP_PORTS','8080','22','110','445'])[k % 11 + 1] as hport from part),
parsed as (select k as line_no, case when k % 10 <> 3 then p_name || ' ' || cast(k as varchar) else 'SnortRule' end as name,
  case when k % 10 <> 4 then cast(k + 1000000 as varchar) end as sid,
  case when hs in ('10.0.0.1', '10.0.0.11', '10.0.0.77') then hs end as src_ip,
  case when hd in ('192.168.1.1', '192.168.1.3', '192.168.1.9', '192.168.1.0') then hd end as dst_ip,
  try_cast(hport as integer) as dst_port, case when hp <> 'ip' then upper(hp) end as proto
  from pick where action <> 'log' and dir = '->' and k % 97 <> 5 and k % 89 <> 7)"""

PART_HITS_SQL = """firsts as (select src_ip, dst_ip, dst_port, proto, min(line_no) as line_no from parsed group by all),
places as (select distinct src_ip, dst_ip, dst_port, proto from packets),
place_hits as (select p.*, min(r.line_no) as line_no from places p join firsts r on (r.src_ip is null or r.src_ip = p.src_ip)
  and (r.dst_ip is null or r.dst_ip = p.dst_ip) and (r.dst_port is null or r.dst_port = p.dst_port)
  and (r.proto is null or r.proto = p.proto) group by all),
part_hits as (select event_id, name, 0.98::double as severity, sid
  from packets join place_hits using (src_ip, dst_ip, dst_port, proto) join parsed r using (line_no))"""
