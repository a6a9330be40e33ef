"""Input views over the test tables: packets, indicators, rule text, training flows and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators import rules as rule_ops
from flowsentry.session import configure

EPOCH_US = 1_704_067_200_000_000

PACKET_SQL = """
select event_id as event_id,
 (us div 43200000000) * 50000000 + (us % 43200000000) div 20000 as t_us,
 case when user_id % 10 < 6 then '10.0.0.1' else '10.0.0.' || cast(10 + user_id % 4 as string) end as src_ip,
 '192.168.1.' || cast(k % 5 as string) as dst_ip,
 cast(1024 + user_id % 4 as int) as src_port,
 case k % 12 when 0 then 21 when 1 then 22 when 2 then 23 when 3 then 25 when 4 then 110 when 5 then 143
   when 6 then 445 when 7 then 3389 when 8 then 5900 when 9 then 80 when 10 then 443 else 53 end as dst_port,
 case event_type when 'view' then 'UDP' when 'purchase' then 'OTHER' else 'TCP' end as proto,
 case event_type when 'click' then 'S' when 'error' then 'S' when 'signup' then 'SA' else '' end as flags,
 40 + cast(floor(value * 10) as bigint) as packet_size
from (select *, unix_micros(cast(ts as timestamp)) - 1704067200000000 as us,
             cast(get_json_object(props, '$.k') as int) as k from {events})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PACKET_SQL, events=table(spark, sf_dir, "events"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of one known source, taken from the packet table itself."""
    return packets(spark, sf_dir).where(F.col("src_ip") == "10.0.0.13").select(F.col("src_ip").alias("ip")).distinct()


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in the shape of incoming JSON events: both key spellings, gaps, and flow counters on some."""
    p = packets(spark, sf_dir)
    n = F.col("event_id")
    counted = (n % 7) == 0
    return p.select(
        "event_id",
        F.timestamp_micros(F.col("t_us")).alias("ts"),
        F.when(n % 2 == 0, F.col("src_ip")).alias("src_ip"),
        F.when(n % 2 == 1, F.col("src_ip")).alias("src"),
        F.when(n % 3 == 0, F.col("dst_ip")).alias("dest_ip"),
        F.when(n % 3 == 1, F.col("dst_ip")).alias("dest"),
        "src_port",
        F.when(n % 11 != 0, F.col("dst_port")).alias("dest_port"),
        F.when(F.col("proto") != "OTHER", F.lower("proto")).alias("proto"),
        F.col("packet_size").alias("bytes"),
        F.nullif(F.col("flags"), F.lit("")).alias("tcp_flags"),
        F.when(counted, (n % 4).cast("double")).alias("IN_PKTS"),
        F.when(counted, (n % 3).cast("double")).alias("OUT_PKTS"),
        F.when(counted & (n % 5 != 0), F.col("packet_size") * 2.0).alias("IN_BYTES"),
        F.when(counted, (n % 100).cast("double")).alias("OUT_BYTES"),
        F.when(counted, (n % 50).cast("double")).alias("FLOW_DURATION_MILLISECONDS"),
    )


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule line per part (line_no, line), in every accepted and refused form."""
    k = F.col("p_partkey")

    def pick(column, options: list[str]):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (column % len(options) + 1).cast("int"))

    header = F.concat_ws(
        " ",
        pick(k, ["alert", "drop", "reject", "pass", "log"]),
        pick(k, ["tcp", "udp", "ip", "http", "icmp", "tcp", "udp"]),
        pick(k, ["any", "10.0.0.1", "$EXTERNAL_NET", "10.0.0.11", "10.0.0.0/8", "!10.0.0.1", "any", "10.0.0.77"]),
        F.lit("any"),
        pick(k, ["->", "->", "->", "->", "->", "->", "->", "->", "<>"]),
        pick(k, ["192.168.1.1", "any", "192.168.1.3", "[192.168.1.1,192.168.1.2]", "192.168.1.9", "192.168.1.0"]),
        pick(k, ["80", "443", "any", "53", "1:1024", "[80,443]", "$HTTP_PORTS", "8080", "22", "110", "445"]),
    )
    message = F.when(k % 10 != 3, F.concat(F.lit('msg:"'), F.col("p_name"), F.lit(" "), k.cast("string"), F.lit('"; ')))
    sid = F.when(k % 10 != 4, F.concat(F.lit("sid:"), (k + 1_000_000).cast("string"), F.lit(";")))
    line = F.concat(header, F.lit(" ("), F.coalesce(message, F.lit("")), F.coalesce(sid, F.lit("")), F.lit(")"))
    line = F.when(k % 97 == 5, F.lit("")).when(k % 89 == 7, F.concat(F.lit("# "), line)).otherwise(line)
    return table(spark, sf_dir, "part").select(k.alias("line_no"), line.alias("line"))


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    text = F.concat(
        F.lit("alert udp 10.0.0."), (10 + r).cast("string"), F.lit(' any -> any 53 (msg:"'), F.col("r_name"),
        F.lit(' lookup"; sid:'), (70_000 + r).cast("string"), F.lit(";)"),
    )
    return table(spark, sf_dir, "region").select(r.cast("long").alias("line_no"), text.alias("line"))


def ordered_lines(lines: DataFrame, tier: int) -> DataFrame:
    return lines.select(rule_ops.rule_order(tier, line=F.col("line_no")).alias("ord"), "line")


def part_rules(spark: SparkSession, sf_dir: str, engine: str = "snort", tier: int = 2) -> DataFrame:
    return rule_ops.parse_rules(ordered_lines(rule_lines(spark, sf_dir), tier), engine)


def cascade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = rule_ops.parse_rules(ordered_lines(region_lines(spark, sf_dir), 1), "snort")
    return rule_ops.rule_union(rule_ops.builtin_rules(spark), region)


def training_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the shape of flow training rows, all values as text, from two sources."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("l_linestatus").alias("source_file"),
        F.when(F.col("l_linenumber") % 2 == 0, "6").otherwise("17").alias("PROTOCOL"),
        F.floor(price).cast("string").alias("IN_BYTES"),
        F.when(F.col("l_partkey") % 50 == 0, "n/a").otherwise(F.floor(q).cast("string")).alias("IN_PKTS"),
        F.floor(price * F.col("l_discount")).cast("string").alias("OUT_BYTES"),
        (F.floor(q / 4)).cast("string").alias("OUT_PKTS"),
        ((F.col("l_suppkey") % 500) * 10).cast("string").alias("FLOW_DURATION_MILLISECONDS"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 3 == 0), "2")
        .when(F.col("l_orderkey") % 41 == 0, "")
        .otherwise("0")
        .alias("Label"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score in 0..1 and a label that mostly follows it."""
    score = F.least(F.abs("value") / 100.0, F.lit(1.0))
    noise = F.col("event_id") % 10 < 2
    label = F.when(noise, F.col("event_id") % 2).otherwise((score >= 0.5).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", score.alias("prob"), label.cast("int").alias("label"))
