"""Readers on input as it really comes: other types, other layouts, broken and missing parts."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from flowsentry.operators import alerts as A
from flowsentry.operators import cascade, decisions, flows, intel, rules
from flowsentry.sources import readers, sinks


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


EVENT = {"src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "src_port": 5, "dest_port": 22, "proto": "tcp", "bytes": 60, "timestamp": "2026-01-01T00:00:00Z"}


def test_events_of_other_types(spark, tmp_path):
    lines = [
        EVENT, {**EVENT, "bytes": "60"}, {**EVENT, "bytes": 60.0}, {**EVENT, "dest_port": " 22"}, {**EVENT, "IN_PKTS": "3"},
        {**EVENT, "bytes": {"odd": 1}}, {**EVENT, "timestamp": 1767225600.0}, {**EVENT, "ts": "2026-01-01 00:00:00", "timestamp": None},
    ]
    path = write(tmp_path / "e.json", *lines, "", "{broken", "[1]", {k: v for k, v in EVENT.items() if k != "timestamp"})
    events = readers.read_flow_events(spark, path)
    rows = events.collect()
    assert events.count() == len(rows) == len(lines) == events.select("event_id").count() == events.select("flags").count()
    assert {(r["packet_size"], r["dst_port"], r["t_us"]) for r in rows} == {(60, 22, 1767225600000000), (0, 22, 1767225600000000)}
    assert len({r["event_id"] for r in rows}) == len(rows) and all(r["event_id"] < 0 for r in rows)
    reasons = sorted(r["reason"] for r in readers.rejected_events(spark, path).collect())
    assert reasons == ["malformed", "malformed", "no time"]
    assert readers.read_flow_events(spark, str(tmp_path / "none")).count() == 0


def test_events_without_ids_raise_the_same_alerts(spark, tmp_path):
    syn = {**EVENT, "tcp_flags": "S"}
    path = write(tmp_path / "e.json", *[syn] * 40)
    none = spark.createDataFrame([], "ip string")
    found = cascade.run_cascade(readers.read_flow_events(spark, path), none, rules.builtin_rules(spark))
    assert "signature:SYNFloodIndicator" in {r["type"] for r in found.collect()}


def test_cascade_refuses_rows_without_key(spark):
    rows = spark.createDataFrame(
        [(None, 1, "a", "b", 1, 2, "TCP", "S", 10)],
        "event_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, flags string, packet_size long",
    )
    none = spark.createDataFrame([], "ip string")
    with pytest.raises(ValueError):
        cascade.run_cascade(rows, none, rules.builtin_rules(spark))


def test_alerts_of_other_types(spark, tmp_path):
    alert = {"id": "x", "timestamp": "2026-01-01T00:00:00Z", "score": 0.5, "model_features": {"duration": 1.0}}
    path = write(tmp_path / "a.json", alert, {**alert, "score": "0.5"}, {**alert, "model_features": "gone", "dst_port": "80"}, "{", "null")
    alerts = readers.read_alerts(spark, path)
    assert alerts.count() == alerts.select("id").count() == len(alerts.collect()) == 3
    assert [r["score"] for r in alerts.collect()] == [0.5] * 3
    assert readers.rejected_lines(spark, path).count() == 2


def test_feeds_and_pulses_over_several_lines(spark, tmp_path):
    feed = {"data": [{"ipAddress": "\t77.1.1.1\n", "abuseConfidenceScore": 1.5, "totalReports": "7"}, {"ipAddress": " \t"}, {"ipAddress": "77.1.1.2"}]}
    page = {"results": [{"indicators": [{"type": "IPv4", "indicator": "\t1.2.3.4\n"}, {"type": "IPv4", "indicator": "1.2.3.400"}]}, {}]}
    for several in (False, True):
        text = (lambda x: json.dumps(x, indent=1)) if several else json.dumps
        rows = readers.read_feed_abuse(spark, write(tmp_path / f"f{several}", text(feed)), multi_line=several).collect()
        assert sorted((r["ip"], r["abuse_score"], r["total_reports"]) for r in rows) == [("77.1.1.1", 1, 7), ("77.1.1.2", 0, 0)]
        pulses = readers.read_pulses(spark, write(tmp_path / f"p{several}", text(page)), multi_line=several)
        assert [r["ip"] for r in pulses.collect()] == ["1.2.3.4"]


def test_c2_feed_shows_what_it_leaves_out(spark, tmp_path):
    entry = {"ip_address": " 9.9.9.9\t", "malware": "m", "port": 443, "status": None}
    mixed = [entry, {"ip_address": ""}, "text", None, 7, [entry], {**entry, "country": {"odd": 1}}]
    for several in (False, True):
        folder = tmp_path / f"c{several}"
        write(folder / "a.json", json.dumps(mixed, indent=1 if several else None))
        write(folder / "b.json", entry)
        write(folder / "c.json", "[{broken")
        write(folder / "d.json", "[]")
        rows = readers.read_feed_c2(spark, str(folder), multi_line=several)
        got = sorted(map(tuple, rows.select("ip", "malware", "port", "status").collect()))
        assert got == [("9.9.9.9", "m", "443", "")] * 3 and rows.count() == 3
        left = [r["value"].strip() for r in readers.rejected_c2(spark, str(folder), multi_line=several).collect() if r["value"]]
        assert sorted(left)[1:] == ["[" + json.dumps(entry).replace(", ", ",").replace(": ", ":") + "]", "[{broken", "text"] and left.count("7") == 1
    assert readers.read_feed_c2(spark, str(tmp_path / "none")).count() == readers.rejected_c2(spark, str(tmp_path / "none")).count() == 0


def test_numbers_of_equal_rows_follow_from_content(spark):
    rows = spark.range(9_000).selectExpr("if(id < 5000, 'same', concat('x', id % 10)) as a", "if(id % 2 = 0, null, 1) as b")
    first, other = readers.numbered(rows), readers.numbered(rows.repartition(7))
    assert sorted(map(str, first.collect())) == sorted(map(str, other.collect()))
    assert first.count() == 9_000 == first.distinct().count() and first.agg(F.max("row_no")).first()[0] == 2_499
    big = readers.numbered(spark.range(10_000).selectExpr("'same' as a"))
    assert sorted(r["row_no"] for r in big.collect()) == list(range(10_000))


def test_csv_by_each_file_header(spark, tmp_path):
    names = ["PROTOCOL", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "Label"]
    write(tmp_path / "c/one.csv", ",".join(names), "6,60,1,0,0,5,1", "NaN,x,,NaN,0,5,NaN")
    write(tmp_path / "c/two.csv", ",".join(reversed(names)) + ",more", "1,5,0,0,1,60,6,z")
    rows = readers.read_flow_csv(spark, str(tmp_path / "c")).select(*names).collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0, 0, 0, 5, 0), (6, 60, 1, 0, 0, 5, 1), (6, 60, 1, 0, 0, 5, 1)]


def test_csv_headers_need_no_sort_of_the_lines(spark, tmp_path, monkeypatch):
    # Several files in a task, one of another order of columns.
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("IN_BYTES"), F.lit("6").alias("PROTOCOL"))
    rows.repartition(3).write.option("header", True).csv(str(tmp_path / "a"))
    rows.where("id < 5").select("PROTOCOL", "IN_BYTES").coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    got = readers.read_flow_csv(spark, str(tmp_path)).agg(F.count("*"), F.sum("IN_BYTES"), F.sum("PROTOCOL"))
    assert plans and not any("Sort" in p for p in plans)
    assert tuple(collect(got)[0]) == (30_005, sum(range(30_000)) + 10, 6.0 * 30_005)


def test_single_rule_file_of_any_name(spark, tmp_path):
    line = 'alert tcp any any -> any 22 (msg:"m"; sid:1;)'
    path = write(tmp_path / "r/my.txt", "# note", line)
    assert readers.read_rules(spark, path).count() == 1
    assert readers.read_rules(spark, str(tmp_path / "r")).count() == 0


def test_requests_of_any_size(spark):
    ids = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(700)]
    requests = spark.createDataFrame(
        [(ids, "resolved", " ok\t"), (["x", "\t" + ids[0] + "\n"], "ignored", None), (ids[:1], "odd", None)],
        "ids array<string>, new_status string, justification string",
    )
    assert decisions.validate_decisions(requests).count() == 701
    assert sorted(r["refusal"] for r in decisions.refused_decisions(requests).collect()) == ["no alert id", "status"]
    assert decisions.validate_decisions(requests, max_ids=500).count() == 501
    assert decisions.refused_decisions(requests, max_ids=500).where("refusal = 'too many ids'").count() == 200


def test_pages_hold_all_groups(spark):
    rows = [(f"10.0.0.{i % 7}", "t", F"2026-01-01 00:{i % 4:02d}:00", "pending", i % 3) for i in range(60)]
    groups = spark.createDataFrame(rows, "src_ip string, type string, window string, status string, s int").selectExpr(
        "src_ip", "concat(type, s) as type", "cast(window as timestamp) as window", "status", "cast(window as timestamp) as latest_ts"
    ).distinct()
    want = [tuple(r) for r in A.page(groups).collect()]
    got, after = [], None
    while rows := A.page(groups, 9, after).collect():
        got += [tuple(r) for r in rows]
        after = rows[-1]
    assert got == want and len(want) == groups.count()
    scored = groups.selectExpr("*", "cast(substr(type, 2) as double) as max_score", "length(src_ip) as count")
    assert [r["max_score"] for r in A.by_score(scored).collect()] == sorted((r["max_score"] for r in scored.collect()), reverse=True)
    assert [r["count"] for r in A.by_count(scored).collect()] == sorted((r["count"] for r in scored.collect()), reverse=True)


def test_null_flow_keys_keep_their_totals(spark):
    rows = [(i, i * 500_000_000 // 10, None, "b", 1, 2, "TCP", "", 10) for i in range(30)]
    packets = spark.createDataFrame(
        rows, "event_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, flags string, packet_size long"
    )
    out = flows.running_flows(packets, block_us=200_000_000).orderBy("t_us").collect()
    assert [r["total_frames"] for r in out] == [float(i + 1) for i in range(30)]


def test_listing_without_cap(spark):
    rows = spark.range(900).selectExpr("id as t_us")
    assert intel.listed(rows, [F.desc("t_us")]).count() == 900 and intel.listed(rows, [F.desc("t_us")], 5).count() == 5


def test_block_log_append_reads_only_the_parts_it_touches(spark, tmp_path):
    def hits(*ips):
        rows = [(ip, 1_000_000 * k, k, "signature:x") for k, ip in enumerate(ips)]
        df = spark.createDataFrame(rows, "src_ip string, t_us long, event_id long, type string")
        return df.withColumn("ts", F.timestamp_micros("t_us"))

    path = str(tmp_path / "blocks")
    sinks.append_block_log(hits(*[f"10.0.{k // 200}.{k % 200}" for k in range(2000)]), path)
    sinks.append_block_log(hits("10.0.0.5", "10.9.9.9", "10.9.9.9", ""), path)
    sinks.append_block_log(hits(), path)
    rows = readers.read_block_log(spark, path)
    assert rows.count() == 2001 == rows.select("src_ip").distinct().count()
    part = rows.where("src_ip = '10.9.9.9'").select(F.pmod(F.xxhash64("src_ip"), F.lit(sinks.BLOCK_PARTS)).alias("p")).first()["p"]
    few = readers.read_block_log(spark, path, [part])
    assert 0 < few.count() < 100 and few.where("src_ip = '10.9.9.9'").count() == 1
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
