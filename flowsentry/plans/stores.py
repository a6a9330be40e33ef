"""Catalogue queries over readers, sinks, feeds and scalar helpers.

Inputs are written from the test tables by Spark, in the stored formats and with broken lines mixed in, and
then read back by the readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry import schemas
from flowsentry.functions import scalars as S
from flowsentry.operators import alerts as A
from flowsentry.operators import decisions, intel
from flowsentry.plans import inputs as I
from flowsentry.plans import oracle as O
from flowsentry.plans.alert_views import ALERTS_AND, BLOCKS_SQL, DETECTED_SQL, alert_store, block_log
from flowsentry.plans.catalog import Catalog
from flowsentry.plans.detection import PARSED_SQL, RAW_SQL
from flowsentry.session import scratch_path
from flowsentry.sources import readers, sinks

ALERT_OUT = "id src_ip dst_ip src_port dst_port protocol type score source sid ml_score hybrid_confirmed".split()


def written_lines(rows: DataFrame, label: str) -> str:
    """Write rows as JSON lines, each tenth line followed by a blank and a broken one."""
    path = scratch_path(rows.sparkSession, label)
    line = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    broken = F.when(F.rand(7) < 0.1, F.concat(line, F.lit("\n\n"), F.substring(line, 1, 20))).otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    return path


def documents_with_pages(spark: SparkSession, sf: str) -> DataFrame:
    texts = I.table(spark, sf, "documents").select("text")
    return texts.unionByName(I.table(spark, sf, "pages").select(F.col("html").alias("text")))


def pulse_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as indicators, grouped into pages by nation."""
    k = F.col("s_suppkey")
    address = F.concat_ws(".", F.lit("45"), (k % 300).cast("string"), F.col("s_nationkey").cast("string"), (k % 7).cast("string"))
    indicator = F.struct(
        F.when(k % 5 == 4, "domain").otherwise("IPv4").alias("type"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), address, F.lit(" "))).otherwise(address).alias("indicator"),
    )
    one = F.struct(F.array(indicator).alias("indicators"))
    return I.table(spark, sf, "supplier").select(F.array(one, F.struct(F.array().cast("array<struct<type:string,indicator:string>>").alias("indicators"))).alias("results"))


PULSES_SQL = """pulses as (select distinct ip from (select '45.' || cast(s_suppkey % 300 as varchar) || '.' ||
  cast(s_nationkey as varchar) || '.' || cast(s_suppkey % 7 as varchar) as ip, s_suppkey % 300 as part2 from supplier
  where s_suppkey % 5 <> 4) where part2 <= 255)"""

#: Letters and digits outside ASCII become "x", so that a word boundary means the same in both engines.
FOUND_SQL = r"""found as (select unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'),
  '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) as ip from (select text from documents union all select html from pages)),
valid as (select distinct ip from found where list_max([cast(p as int) for p in string_split(ip, '.')]) <= 255)"""


def abuse_entries(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    entry = F.struct(
        F.when(c % 13 != 0, F.concat(F.lit(" 77.1."), (c % 256).cast("string"), F.lit("."), (c % 200).cast("string"))).otherwise(" ").alias("ipAddress"),
        F.when(c % 4 != 0, (c % 101).cast("int")).alias("abuseConfidenceScore"),
        F.when(c % 3 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("countryCode"),
        F.when(c % 5 != 0, F.concat(F.lit("Net "), F.col("c_mktsegment"))).alias("isp"),
        F.lit("2026-01-01T00:00:00+00:00").alias("lastReportedAt"),
        (c % 9).cast("int").alias("totalReports"),
    )
    return I.table(spark, sf, "customer").select(F.array(entry).alias("data"))


ABUSE_SQL = """abuse as (select '77.1.' || cast(c_custkey % 256 as varchar) || '.' || cast(c_custkey % 200 as varchar) as ip,
  case when c_custkey % 4 <> 0 then cast(c_custkey % 101 as integer) else 0 end as abuse_score,
  case when c_custkey % 3 <> 0 then 'N' || cast(c_nationkey as varchar) else '' end as country,
  case when c_custkey % 5 <> 0 then 'Net ' || c_mktsegment else '' end as isp, '2026-01-01T00:00:00+00:00' as last_report,
  cast(c_custkey % 9 as integer) as total_reports from customer where c_custkey % 13 <> 0)"""


def c2_entries(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(
        F.when(s % 11 != 0, F.concat(F.lit("91.2."), (s % 256).cast("string"), F.lit(".9"))).otherwise("").alias("ip_address"),
        F.when(s % 2 == 0, F.concat(F.lit("Bot"), (s % 6).cast("string"))).alias("malware"),
        F.when(s % 3 == 0, "online").otherwise("offline").alias("status"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country"),
        F.lit("2025-01-01").alias("first_seen"),
        F.lit(None).cast("string").alias("last_online"),
        (s % 1000).cast("string").alias("port"),
    )


C2_SQL = """c2 as (select '91.2.' || cast(s_suppkey % 256 as varchar) || '.9' as ip,
  case when s_suppkey % 2 = 0 then 'Bot' || cast(s_suppkey % 6 as varchar) else '' end as malware,
  case when s_suppkey % 3 = 0 then 'online' else 'offline' end as status, 'N' || cast(s_nationkey as varchar) as country,
  '2025-01-01' as first_seen, '' as last_online, cast(s_suppkey % 1000 as varchar) as port from supplier where s_suppkey % 11 <> 0)"""


def read_abuse(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_feed_abuse(spark, written_lines(abuse_entries(spark, sf), "abuse"))


def read_c2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "c2")
    c2_entries(spark, sf).write.json(path)
    return readers.read_feed_c2(spark, path)


def register(c: Catalog) -> None:
    alert_sql = ", ".join(ALERT_OUT)

    @c.add("src1_read_alerts", O.WITH_ALERTS + f"select {alert_sql}, t_us, round(duration, 6) as duration from alerts")
    def src1(spark, sf):
        store = alert_store(spark, sf)
        path = written_lines(store.select(*decisions.alert_record(store)), "alerts")
        rows = readers.read_alerts(spark, path)
        return rows.select(
            *ALERT_OUT, F.unix_micros("ts").alias("t_us"), F.round("model_features.duration", 6).alias("duration")
        )

    @c.add("snk1_append_alerts", O.WITH_ALERTS + f"select {alert_sql}, t_us from alerts")
    def snk1(spark, sf):
        path = scratch_path(spark, "alert-store")
        store = alert_store(spark, sf)
        sinks.append_alerts(store.where(F.col("source") == "ml"), path)
        sinks.append_alerts(store.where(F.col("source") != "ml"), path)
        return readers.read_alerts(spark, path).select(*ALERT_OUT, F.unix_micros("ts").alias("t_us"))

    @c.add("src2_read_flow_events", O.chain(O.PACKETS, RAW_SQL) + "select * from raw")
    def src2(spark, sf):
        return readers.read_flow_events(spark, written_lines(I.raw_events(spark, sf), "events"))

    @c.add(
        "src3_read_flow_csv",
        """select case when l_linenumber % 2 = 0 then 6.0::double else 17.0::double end as PROTOCOL, floor(l_extendedprice) as IN_BYTES,
           case when l_partkey % 50 = 0 then 0 else floor(l_quantity) end as IN_PKTS, floor(l_extendedprice * l_discount) as OUT_BYTES,
           floor(l_quantity / 4) as OUT_PKTS, cast(l_suppkey % 500 * 10 as double) as FLOW_DURATION_MILLISECONDS,
           case when l_returnflag = 'R' and l_partkey % 3 = 0 then 2.0::double else 0.0::double end as "Label" from lineitem""",
    )
    def src3(spark, sf):
        path = scratch_path(spark, "flows")
        I.training_flows(spark, sf).write.option("header", True).csv(path)
        return readers.read_flow_csv(spark, path).select(*schemas.FLOW_CSV_COLUMNS)

    rule_out = ["name", "sid", "src_ip", "dst_ip", "dst_port", "proto"]

    @c.add(
        "src4_read_rules",
        "with " + PARSED_SQL + f""" select {', '.join(rule_out)}, row_number() over (order by folder, line_no) as place
          from (select *, line_no % 3 as folder from parsed)""",
    )
    def src4(spark, sf):
        path = scratch_path(spark, "rules")
        lines = I.rule_lines(spark, sf)
        for part in (2, 0, 1):  # the order of the folders' names counts, not that of writing
            rows = lines.where(F.col("line_no") % 3 == part).orderBy("line_no")
            rows.select("line").coalesce(1).write.text(f"{path}/rules{part}")
        # Written part files end in .txt; the folder reader looks for *.rules, so it is given another pattern here.
        rules = readers.read_rules(spark, path, pattern="*.txt")
        return A.placed(rules.orderBy("ord")).select(*rule_out, "place")

    @c.add("src5_read_ioc_text", "with " + FOUND_SQL + " select ip from valid")
    def src5(spark, sf):
        path = scratch_path(spark, "ioc-text")
        documents_with_pages(spark, sf).write.text(path)
        return readers.read_ioc_text(spark, path)

    @c.add("src6_read_pulses", "with " + PULSES_SQL + " select ip from pulses")
    def src6(spark, sf):
        return readers.read_pulses(spark, written_lines(pulse_pages(spark, sf), "pulses"))

    @c.add("src7_read_feed_abuse", "with " + ABUSE_SQL + " select * from abuse")
    def src7(spark, sf):
        return read_abuse(spark, sf)

    @c.add("src8_read_feed_c2", "with " + C2_SQL + " select * from c2")
    def src8(spark, sf):
        return read_c2(spark, sf)

    @c.add(
        "flt3_feed_search",
        "with " + ABUSE_SQL + ", " + C2_SQL
        + """ select 'abuse' as feed, ip from abuse where contains(ip, 'n1') or contains(lower(isp), 'n1') or contains(lower(country), 'n1')
            union all select 'c2', ip from c2 where contains(ip, 'n1') or contains(lower(malware), 'n1')
            union all select 'c2 table', ip from c2 where contains(ip, 'n1') or contains(lower(malware), 'n1') or contains(lower(country), 'n1')""",
    )
    def flt3(spark, sf):
        parts = {
            "abuse": intel.search_abuse(read_abuse(spark, sf), "N1"),
            "c2": intel.search_c2(read_c2(spark, sf), "N1"),
            "c2 table": intel.search_c2(read_c2(spark, sf), "N1", with_country=True),
        }
        out = None
        for name, rows in parts.items():
            part = rows.select(F.lit(name).alias("feed"), "ip")
            out = part if out is None else out.unionByName(part)
        return out

    @c.add(
        "agg13_feed_counts",
        "with " + ABUSE_SQL + ", " + C2_SQL
        + " select 'abuse' as feed, count(*) as entries from abuse union all select 'c2', count(*) from c2",
    )
    def agg13(spark, sf):
        return intel.feed_counts(abuse=read_abuse(spark, sf), c2=read_c2(spark, sf))

    @c.add(
        "agg13_blocked_count",
        ALERTS_AND + BLOCKS_SQL + ", " + DETECTED_SQL
        + " select 'blocked' as feed, count(*) as entries from blocks union all select 'detected', count(*) from detected",
    )
    def agg13_blocked(spark, sf):
        store, log = alert_store(spark, sf), block_log(spark, sf)
        blocked = A.blocked_or_detected(log, store)
        return intel.feed_counts(blocked=blocked, detected=A.blocked_or_detected(log.where("1 = 0"), store))

    union_sql = "with " + FOUND_SQL + ", " + PULSES_SQL + " select ip from valid union select ip from pulses"

    @c.add("set2_indicator_union", union_sql)
    def set2(spark, sf):
        text = intel.indicators_in_text(documents_with_pages(spark, sf), "text")
        pulses = readers.read_pulses(spark, written_lines(pulse_pages(spark, sf), "pulses"))
        return intel.indicator_union(text, pulses)

    @c.add(
        "agg12_distinct_indicators",
        f"select count(*) as indicators, min(ip) as first_ip, max(ip) as last_ip from ({union_sql})",
    )
    def agg12(spark, sf):
        ips = set2(spark, sf)
        return ips.agg(F.count(F.lit(1)).alias("indicators"), F.min("ip").alias("first_ip"), F.max("ip").alias("last_ip"))

    @c.add(
        "snk2_append_block_log",
        ALERTS_AND + BLOCKS_SQL + " select src_ip, t_us, reason, 'block-signature' as mode from blocks",
    )
    def snk2(spark, sf):
        path = scratch_path(spark, "blocks")
        sinks.append_block_log(alert_store(spark, sf), path)
        sinks.append_block_log(alert_store(spark, sf), path)
        rows = readers.read_block_log(spark, path)
        return rows.select("src_ip", F.unix_micros("ts").alias("t_us"), "reason", "mode")

    @c.add("snk3_append_soc_queue", O.WITH_ALERTS + "select id, 'queued_soc' as action, score from alerts where source = 'ml'")
    def snk3(spark, sf):
        from flowsentry.functions.labels import policy_action

        path = scratch_path(spark, "soc-queue")
        queued = alert_store(spark, sf).withColumn("action", policy_action("soc-queue-ml", F.col("source") != "ml"))
        sinks.append_soc_queue(queued, path)
        return readers.read_alerts(spark, path).select("id", "action", "score")

    @c.add("sc1_extract_ipv4", "with " + FOUND_SQL + " select ip, count(*) as n from found group by 1")
    def sc1(spark, sf):
        found = documents_with_pages(spark, sf).select(F.explode(S.extract_ipv4(F.col("text"))).alias("ip"))
        return found.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))

    @c.add("sc2_valid_ipv4", "with " + FOUND_SQL + " select ip, ip in (select ip from valid) as valid from (select distinct ip from found)")
    def sc2(spark, sf):
        return sc1(spark, sf).select("ip", S.valid_ipv4(F.col("ip")).alias("valid"))

    @c.add("sc3_minute_floor", "select event_id, epoch_us(date_trunc('minute', ts)) as minute_us from events")
    def sc3(spark, sf):
        minute = S.minute_floor(F.col("ts").cast("timestamp"))
        return I.table(spark, sf, "events").select("event_id", F.unix_micros(minute).alias("minute_us"))

    @c.add("sc4_clip", "select event_id, least(greatest(value, 1), 50) as value from events")
    def sc4(spark, sf):
        return I.table(spark, sf, "events").select("event_id", S.clip(F.col("value"), 1.0, 50.0).alias("value"))

    @c.add("sc5_round4", "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7.0::double, 4) as x from lineitem")
    def sc5(spark, sf):
        rows = I.table(spark, sf, "lineitem")
        return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.round4(F.col("l_extendedprice") / 7.0).alias("x"))

    @c.add(
        "sc7_string_ops",
        """select c_custkey, upper(trim(c_mktsegment)) as u, lower(c_name) as l, replace(c_name, '#', ':') as r,
           starts_with(c_mktsegment, 'A') as p, contains(c_mktsegment, 'OU') as h, substr(c_name, 1, 5) as s from customer""",
    )
    def sc7(spark, sf):
        name, segment = F.col("c_name"), F.col("c_mktsegment")
        return I.table(spark, sf, "customer").select(
            "c_custkey",
            F.upper(F.trim(segment)).alias("u"),
            F.lower(name).alias("l"),
            F.replace(name, F.lit("#"), F.lit(":")).alias("r"),
            F.startswith(segment, F.lit("A")).alias("p"),
            F.contains(segment, F.lit("OU")).alias("h"),
            F.substring(name, 1, 5).alias("s"),
        )

    @c.add(
        "sc8_date_ops",
        """select event_id, strftime(ts, '%d/%m %H:00') as label, epoch_us(ts) as parsed_us,
           round((1706659200000000 - epoch_us(ts)) / 3600000000.0::double, 6) as age from events""",
    )
    def sc8(spark, sf):
        ts = F.col("ts").cast("timestamp")
        as_of = F.timestamp_micros(F.lit(1_706_659_200_000_000))
        return I.table(spark, sf, "events").select(
            "event_id",
            F.date_format(ts, "dd/MM HH:00").alias("label"),
            F.unix_micros(S.parse_iso(S.iso_text(ts))).alias("parsed_us"),
            F.round(S.age_hours(ts, as_of), 6).alias("age"),
        )

    @c.add("sc9_json_ops", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
    def sc9(spark, sf):
        parsed = F.from_json("props", "k int")
        return I.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))

    @c.add(
        "sc10_array_ops",
        """select l_orderkey, count(*) as n, min(l_linenumber) as first_line,
           string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as joined, bool_or(l_linenumber > 5) as any_late
           from lineitem group by 1""",
    )
    def sc10(spark, sf):
        lines = F.sort_array(F.collect_list("l_linenumber"))
        return (
            I.table(spark, sf, "lineitem")
            .groupBy("l_orderkey")
            .agg(lines.alias("lines"))
            .select(
                "l_orderkey",
                F.size("lines").cast("long").alias("n"),
                F.element_at("lines", 1).alias("first_line"),
                F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("joined"),
                F.exists("lines", lambda x: x > 5).alias("any_late"),
            )
        )

    @c.add(
        "sc11_safe_cast",
        """select event_id, try_cast(t as double) as x, coalesce(try_cast(t as double), 0) as y from (select event_id,
           case event_id % 3 when 0 then cast(event_id as varchar) when 1 then 'x' || cast(event_id as varchar) end as t from events)""",
    )
    def sc11(spark, sf):
        n = F.col("event_id")
        text = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, F.concat(F.lit("x"), n.cast("string")))
        return I.table(spark, sf, "events").select(n, S.safe_double(text).alias("x"), S.safe_double(text, 0.0).alias("y"))

