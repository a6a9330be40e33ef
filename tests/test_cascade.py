import re

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import cascade, intel, rules as R, thresholds
from flowsentry.plans import inputs as I
from flowsentry.sources import readers
from flowsentry.streaming import jobs
from tests import reference_model as model
from tests.conftest import SF
from tests.test_windows import packets

S = 1_000_000


def no_rules(spark):
    return R.builtin_rules(spark).where("name = 'none'")


def test_counting_stages_match_a_sequential_pass(spark):
    flagged = intel.ioc_match(I.packets(spark, SF), I.indicators(spark, SF))
    got = cascade.counting_stages(flagged, cascade.CascadeConfig()).hits.collect()
    want = model.counting_stages([r.asDict() for r in I.packets(spark, SF).collect()], {"10.0.0.13"})
    assert sorted((r["event_id"], r["name"], round(r["severity"], 6)) for r in got) == sorted(want)
    assert len(want) == 97


def test_each_event_raises_at_most_one_alert_in_stage_order(spark):
    df, _ = packets(spark, [dict(t_us=i, dst_port=23) for i in range(40)])
    bad = spark.createDataFrame([("10.0.0.2",)], "ip string")
    everything_bad = cascade.run_cascade(df, bad, R.builtin_rules(spark))
    assert everything_bad.groupBy("type").count().collect() == [("signature:ThreatIntel_IPv4_IOC", 40)]

    nothing_bad = bad.where("ip = ''")
    alerts = cascade.run_cascade(df, nothing_bad, R.builtin_rules(spark))
    counts = {r["type"]: r["count"] for r in alerts.groupBy("type").count().collect()}
    assert counts == {
        "signature:SYNFloodIndicator": 1, "signature:L7BruteForce_Telnet": 1, "signature:TelnetBruteforcePattern": 38
    }
    assert alerts.select("event_id").distinct().count() == 40 == alerts.select("id").distinct().count()


def test_brute_force_is_escalated_when_the_model_agrees(spark):
    df, _ = packets(spark, [dict(t_us=i, dst_port=22, packet_size=400) for i in range(6)])
    nothing = spark.createDataFrame([], "ip string")
    alert = cascade.run_cascade(df, nothing, no_rules(spark)).where("type like '%SSH'").first()
    assert alert["hybrid_confirmed"] and alert["score"] == round(min((0.95 + 0.75) / 2 + 0.05, 0.99), 4)
    assert alert["ml_score"] == 0.75


def test_heuristic_meets_its_own_threshold(spark):
    df, _ = packets(spark, [dict(dst_port=22, packet_size=1201, t_us=0)])
    alerts = cascade.run_cascade(df, spark.createDataFrame([], "ip string"), no_rules(spark)).collect()
    assert [(a["type"], a["score"], a["source"]) for a in alerts] == [("xgboost_anomaly", 0.75, "ml")]


@pytest.mark.parametrize("mode, signature, ml", [
    ("detect-only", "detect", "detect"), ("block-signature", "blocked", "detect"), ("soc-queue-ml", "detect", "queued_soc"),
])
def test_policy_modes(spark, mode, signature, ml):
    df, _ = packets(spark, [dict(dst_port=22, packet_size=1300, t_us=0), dict(dst_port=3389, t_us=1)])
    alerts = cascade.run_cascade(
        df, spark.createDataFrame([], "ip string"), R.builtin_rules(spark), cascade.CascadeConfig(mode=mode)
    )
    assert {r["source"]: r["action"] for r in alerts.collect()} == {"ml": ml, "builtin": signature}


LINES = [
    'alert tcp any any -> any 22 (msg:"one"; sid:1;)',
    "# alert tcp any any -> any 22 (sid:2;)",
    "",
    'drop ip 10.0.0.0/8 any -> 192.168.1.1 any (sid:3; msg:"three")',
    'pass udp !10.0.0.1 any -> [10.0.0.1,10.0.0.2] 1:1024 (msg:"four";)',
    'alert tcp any any <> any 22 (msg:"both ways";)',
    'alert http $HOME any -> any 080 (content:"msg:inner"; sid: 7 ;)',
    "reject icmp any any -> any any (sid:8;)  ",
    "log tcp any any -> any 22 (sid:9;)",
]


def rule_rows(spark, **options):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")
    return R.parse_rules(I.ordered_lines(lines, 2), **options).orderBy("ord").collect()


def test_rule_forms(spark):
    got = [(r["ord"]["line"], r["name"], r["sid"], r["src_ip"], r["dst_ip"], r["dst_port"], r["proto"]) for r in rule_rows(spark)]
    assert got == [
        (0, "one", "1", None, None, 22, "TCP"),
        (3, "three", "3", None, "192.168.1.1", None, None),
        (4, "four", None, None, None, None, "UDP"),
        (6, "inner", "7", None, None, 80, "HTTP"),
        (7, "SnortRule", "8", None, None, None, "ICMP"),
    ]
    strict = rule_rows(spark, skip_unrepresentable=True)
    assert [r["ord"]["line"] for r in strict] == [0, 7]


def test_first_rule_wins_with_and_without_broadcast(spark):
    df, _ = packets(spark, [
        dict(t_us=0, dst_port=22), dict(t_us=1, dst_port=80, proto="UDP"), dict(t_us=2, dst_port=0, proto="OTHER"),
        dict(t_us=3, src_ip="9.9.9.9", dst_port=22),
    ])
    rows = [(0, None, None, 22, "UDP"), (1, None, None, 22, None), (2, "9.9.9.9", None, None, None), (3, None, "10.0.0.2", 80, "UDP"),
            (4, None, None, None, "UDP"), (5, None, None, 0, "OTHER")]
    rules = spark.createDataFrame(rows, "line long, src_ip string, dst_ip string, dst_port int, proto string").select(
        R.rule_order(1, line=F.col("line")).alias("ord"), F.concat(F.lit("r"), F.col("line").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("sid"), "src_ip", "dst_ip", "dst_port", "proto", F.lit(0.9).alias("severity"),
        F.lit("snort").alias("source_engine"))
    for limit in (1_000, 0):
        got = R.first_rule_match(df, rules, limit).orderBy("event_id").collect()
        assert [r["rule"]["name"] for r in got] == ["r1", "r3", "r5", "r1"]
    # One rule without any condition takes what is left.
    wild = rules.where("line = 0").withColumns({f: F.lit(None).cast(t) for f, t in (("dst_port", "int"), ("proto", "string"))})
    got = R.first_rule_match(df, wild.unionByName(rules.where("line = 2"))).orderBy("event_id").collect()
    assert [r["rule"]["name"] for r in got] == ["r0"] * 4


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_nested_loops_in_lookups(spark):
    rows = I.packets(spark, SF)
    matched = R.first_rule_match(intel.ioc_match(rows, I.indicators(spark, SF)), I.part_rules(spark, SF))
    for df in (matched, thresholds.service_lookup(rows)):
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert "BroadcastHashJoin" in text
    large = intel.ioc_match(rows, I.indicators(spark, SF), small=False)
    assert "NestedLoop" not in plan(large) and "CartesianProduct" not in plan(large)


def test_alert_ids_are_stable_uuids(spark):
    df, _ = packets(spark, [dict(dst_port=3389, t_us=5)])
    run = lambda: cascade.run_cascade(df, spark.createDataFrame([], "ip string"), R.builtin_rules(spark)).first()["id"]
    first = run()
    assert first == run() and len(first) == 36


def event_line(t_ms, src="10.0.0.1", size=60):
    return f'{{"timestamp": "{t_ms / 1000:.3f}", "src_ip": "{src}", "dest_ip": "10.9.9.9", "dest_port": 22, "proto": "tcp", "bytes": {size}, "tcp_flags": "S"}}'


def alert_ids(spark, folder):
    events = readers.read_flow_events(spark, str(folder))
    return {r["id"] for r in cascade.run_cascade(events, spark.createDataFrame([], "ip string"), no_rules(spark)).select("id").collect()}


def test_alert_ids_stay_when_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    # Equal lines among them: sixty attempts, some at one time and of one content.
    lines = [event_line(1_000 + 20 * (i // 3)) for i in range(60)]
    (tmp_path / "in" / "b.json").write_text("\n".join(lines))
    before = alert_ids(spark, tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text("\n".join(event_line(1_000 + i, f"10.1.{i % 9}.{i % 200}") for i in range(3000)))
    after = alert_ids(spark, tmp_path / "in")
    assert len(before) >= 2 and before <= after
    # In other files, the same events have the same names.
    (tmp_path / "split").mkdir()
    for k in range(3):
        (tmp_path / "split" / f"{k}.json").write_text("\n".join(lines[k::3]))
    assert alert_ids(spark, tmp_path / "split") == before


def test_event_names_are_alike_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    given = '{"event_id": 5, "timestamp": "2", "src_ip": "10.0.0.3", "dest_ip": "10.9.9.9", "bytes": 1}'
    lines = [event_line(1_000 + 50 * (i // 4)) for i in range(80)] + [given, given, event_line(99), '{"src_ip": "no time"}']
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines[k::2]))
    batch = readers.read_flow_events(spark, str(tmp_path / "in"))
    names = [r["event_id"] for r in batch.collect()]
    assert len(names) == len(set(names)) == 82 and names.count(5) == 1
    nothing, rules = spark.createDataFrame([], "ip string"), no_rules(spark)
    want = {r["id"] for r in cascade.run_cascade(batch, nothing, rules).collect()}
    job = jobs.CascadeStream(spark, str(tmp_path / "job"), 5_000_000, nothing, rules)
    job.start(readers.stream_flow_events(spark, str(tmp_path / "in"), 1)).awaitTermination()
    job.finish()
    assert {r["id"] for r in job.alerts().collect()} == want and len(want) >= 2
    assert job.late_rows().count() >= 1


def test_many_equal_events_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(readers, "EQUAL_EVENTS", 16)
    rows = spark.range(1000).select(F.lit(None).cast("long").alias("event_id"), (F.col("id") % 2 + F.col("id") % 3 * 0).alias("t"))
    named = readers.event_keys(rows)
    assert named.count() == 1000 == named.select("event_id").distinct().count()
    more = readers.event_keys(rows.unionByName(rows.limit(300)))
    assert named.exceptAll(more).isEmpty()


def test_repeated_event_ids(spark):
    # Ids that come again at other times are other events: a cooldown of 10 s allows 11 alerts in 110 s.
    rows = [dict(t_us=i * 27_500, event_id=i // 4) for i in range(4000)]
    df, _ = packets(spark, rows)
    nothing, rules = spark.createDataFrame([], "ip string"), no_rules(spark)
    alerts = cascade.run_cascade(df, nothing, rules).where("type like '%SYNFlood%'")
    assert alerts.count() == 11 == alerts.select("id").distinct().count()
    # The same event delivered four times is one.
    once, _ = packets(spark, [dict(t_us=i * 100_000) for i in range(400)])
    again = once.unionByName(once).unionByName(once).unionByName(once)
    want = cascade.run_cascade(once, nothing, rules)
    got = cascade.run_cascade(again, nothing, rules)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_input_is_read_once_and_nameless_events_are_refused(spark, tmp_path):
    df, _ = packets(spark, [dict(t_us=i, dst_port=23) for i in range(40)])
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    nothing, rules = spark.createDataFrame([], "ip string"), no_rules(spark)
    alerts = cascade.run_cascade(df, nothing, rules)
    plan = alerts._jdf.queryExecution().optimizedPlan().toString() + str(alerts.inputFiles())
    assert str(tmp_path) not in plan
    with pytest.raises(ValueError, match="event_id"):
        cascade.run_cascade(df.withColumn("event_id", F.lit(None).cast("long")), nothing, rules)


def longest_method(df):
    """Bytes of the longest method Spark generates for a plan; from 8000 on the JVM never compiles it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df.sparkSession._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_heavy_stages_are_short_enough_to_be_compiled(spark):
    flagged = intel.ioc_match(I.packets(spark, SF), I.indicators(spark, SF))
    watched = thresholds.service_lookup(flagged.select("src_ip", "dst_port", "t_us", "event_id"))
    hits = thresholds.login_candidates(watched).groupBy("src_ip", "dst_port", "t_us").agg(F.min(F.struct("event_id", "service", "over")))
    assert longest_method(hits) < 8000
    alerts = cascade.run_cascade(I.packets(spark, SF), I.indicators(spark, SF), I.cascade_rules(spark, SF))
    assert longest_method(alerts) < 8000


def test_rows_beyond_the_limit_are_counted_over_block_borders(spark):
    """Against a count over the plain list; blocks of a few rows, needs of several services, rows of no service."""
    times = [0, 1, 1, 2, 9, 30, 31, 31, 32, 33, 34, 35, 36, 60, 61, 62, 63, 64, 65, 66, 95, 96]
    rows = [("a", p, t * S, 100 * p + i) for p in (21, 22, 3389) for i, t in enumerate(times)] + [("b", 22, 5 * S, 1)]
    watched = thresholds.service_lookup(spark.createDataFrame(rows, "src_ip string, dst_port int, t_us long, event_id long"))
    want = set()
    for s in thresholds.LOGIN_SERVICES:
        own = sorted((r for r in rows if r[0] == "a" and r[1] == s.port), key=lambda r: (r[2], r[3]))
        for i, r in enumerate(own):
            reached = sum(i >= s.attempts - 1 + j and r[2] - own[i - s.attempts + 1 - j][2] <= s.window_s * S for j in range(5))
            want |= {(r[3], reached - 1)} if reached else set()
    assert want and {n for _, n in want} >= {0, 4}
    for most in (3, 1000):
        got = thresholds.login_candidates(watched, block_us=S, most=most).collect()
        assert {(r["event_id"], r["over"]) for r in got} == want and len(got) == len(want)
