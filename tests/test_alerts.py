import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators import alerts as A
from flowsentry.operators import decisions as D
from flowsentry.operators import training
from flowsentry.session import scratch_path
from flowsentry.sources import readers

AS_OF = datetime(2026, 1, 2, tzinfo=timezone.utc)


def uid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def write_lines(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(l if isinstance(l, str) else json.dumps(l) for l in lines) + "\n")
    return str(path)


def alert(n, **kw):
    base = dict(id=uid(n), timestamp="2026-01-01T10:00:00+00:00", src_ip="1.1.1.1", dst_ip="2.2.2.2", src_port=1, dst_port=22,
                protocol="TCP", type="signature:x", score=0.9, action="detect", source="snort", status="pending")
    return {**base, **kw}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    lines = [
        alert(1, timestamp="2026-01-01T10:00:30Z", dst_ip="first", source="otx", sid="7"),
        alert(2, timestamp="2026-01-01T17:00:50+07:00", dst_ip="last", score=0.95),
        alert(3, timestamp="2026-01-01T10:00:50+00:00", dst_ip="same time"),
        alert(4, status=None, timestamp="2026-01-01T10:01:00+00:00"),
        alert(5, status="resolved"),
        alert(6, timestamp="", score=0.55),
        alert(7, src_ip="8.8.8.8", type="xgboost_anomaly", source="ml", score=0.80),
        "", "{broken", '["no alert"]',
    ]
    path = write_lines(tmp_path_factory.mktemp("alerts"), "alerts.json", lines)
    return readers.read_alerts(spark, path, F.lit(AS_OF)).cache()


def test_reader_skips_broken_lines_and_missing_files(spark, store, tmp_path):
    assert store.count() == 7
    none = str(tmp_path / "none")
    for read in (readers.read_alerts, readers.read_rules, readers.read_ioc_text, readers.read_pulses, readers.read_feed_abuse,
                 readers.read_feed_c2, readers.read_block_log, readers.read_feedback, readers.read_runs):
        assert read(spark, none).isEmpty()


def test_times_are_parsed_with_offsets(store):
    got = {r["id"]: r["ts"].astimezone(timezone.utc) for r in store.select("id", "ts").collect()}
    assert got[uid(2)] == datetime(2026, 1, 1, 10, 0, 50, tzinfo=timezone.utc) == got[uid(3)]
    assert got[uid(6)] == AS_OF


def test_groups_take_context_from_the_right_rows(store):
    early = A.group_alerts(store).where("src_ip = '1.1.1.1' and window < timestamp'2026-01-01 12:00:00'")
    groups = {(r["status"], r["window"].minute): r for r in early.collect()}
    g = groups[("pending", 0)]
    assert g["count"] == 3
    assert (g["source"], g["sid"], g["dst_ip"], g["max_score"]) == ("otx", "7", "last", 0.95)
    assert groups[("pending", 1)]["count"] == 1
    assert A.group_pending_alerts(store).agg(F.sum("count")).first()[0] == 6


def test_member_ids_keep_time_order(store):
    rows = A.group_member_ids(store, 10_000_000).where("status = 'pending' and src_ip = '1.1.1.1'").orderBy("window", "slice")
    assert [r["ids"] for r in rows.collect()][:2] == [[uid(1)], [uid(2), uid(3)]]


def test_counts(store):
    assert A.status_counts(store).first().asDict() == dict(pending=6, ignored=0, resolved=1, total=7)
    assert {r["severity"]: r["n"] for r in A.count_by_severity(store).collect()} == dict(CRITICAL=1, HIGH=5, MEDIUM=1, LOW=0)


def test_empty_store_still_reports_all_severities_and_layers(store):
    empty = store.where("1 = 0")
    assert {r["n"] for r in A.count_by_severity(empty).collect()} == {0}
    assert [r["hit"] for r in A.layer_mapping(empty).collect()] == [False] * 7


def test_timeline_labels(store):
    rows = {r["label"]: r["count"] for r in A.alert_timeline(store, F.lit(datetime(2026, 1, 1, 11, 0, tzinfo=timezone.utc))).collect()}
    assert rows == {"10:00": 5, "10:01": 1, "00:00": 1}
    rows = {r["label"]: r["count"] for r in A.alert_timeline(store, F.lit(datetime(2026, 1, 3, 10, 0, 30, tzinfo=timezone.utc))).collect()}
    assert rows == {"01/01 10:00": 4, "02/01 00:00": 1}


def test_block_list_falls_back_to_detections(spark, store):
    log = spark.createDataFrame([("5.5.5.5", "b", AS_OF, "m"), ("", "b", AS_OF, "m")], "src_ip string, reason string, ts timestamp, mode string")
    assert [r["src_ip"] for r in A.blocked_or_detected(log, store).collect()] == ["5.5.5.5"]
    fallback = A.blocked_or_detected(log.where("src_ip = ''"), store).collect()
    assert [(r["src_ip"], r["mode"]) for r in fallback] == [("1.1.1.1", "detect-only")]


def decide(spark, store, rows):
    schema = "ids array<string>, new_status string, justification string, decision_ts timestamp"
    stamped = [(*r, datetime(2026, 1, 1, 12, i, tzinfo=timezone.utc)) for i, r in enumerate(rows)]
    return D.apply_decisions(store, D.validate_decisions(spark.createDataFrame(stamped, schema)))


def test_decisions_close_pending_alerts_once(spark, store):
    out = decide(spark, store, [
        ([uid(1)], "pending", "look again"),
        ([uid(1), uid(5), "nonsense"], "Ignored", " <b>noise</b> "),
        ([uid(1), uid(4)], "resolved", ""),
        ([uid(2)], "deleted", "not a status"),
    ])
    rows = {r["id"]: r for r in out.collect()}
    assert (rows[uid(1)]["status"], rows[uid(1)]["ignore_justification"], rows[uid(1)]["resolve_justification"]) == (
        "ignored", "noise", "look again")
    assert (rows[uid(4)]["status"], rows[uid(4)]["resolve_justification"]) == ("resolved", None)
    assert not rows[uid(5)]["changed"] and not rows[uid(2)]["changed"]
    feedback = {r["alert_id"]: r for r in D.feedback_rows(out).collect()}
    assert {k: (v["decision"], v["justification"]) for k, v in feedback.items()} == {
        uid(1): ("ignored", "noise"), uid(4): ("resolved", None)}


def test_all_ids_of_a_request_count_unless_limited(spark):
    ids = [uid(n) for n in range(600)]
    requests = spark.createDataFrame([(ids, "ignored", None)], "ids array<string>, new_status string, justification string")
    assert D.validate_decisions(requests).count() == 600
    assert D.validate_decisions(requests, max_ids=500).count() == 500


def test_justification_is_cut_before_tags_are_stripped(spark):
    text = "<b>" + "x" * 600
    got = spark.range(1).select(L.clean_justification(F.lit(text))).first()[0]
    assert got == "x" * 497


@pytest.mark.parametrize("score, four, three", [
    (0.95, "CRITICAL", "HIGH"), (0.9499, "HIGH", "HIGH"), (0.8, "HIGH", "MEDIUM"), (0.55, "MEDIUM", "LOW"), (0.5499, "LOW", "LOW")])
def test_severity_edges(spark, score, four, three):
    assert tuple(spark.range(1).select(L.severity4(F.lit(score)), L.priority3(F.lit(score))).first()) == (four, three)


def test_addresses_in_text(spark):
    text = "1.2.3.4.5 at 256.1.1.1, é9.9.9.9 x8.8.8.8 007.1.1.1 (10.0.0.1) 1.2.3.4"
    found = spark.range(1).select(F.explode(S.extract_ipv4(F.lit(text))).alias("ip"))
    got = {r["ip"]: r["ok"] for r in found.select("ip", S.valid_ipv4(F.col("ip")).alias("ok")).collect()}
    assert got == {"1.2.3.4": True, "256.1.1.1": False, "007.1.1.1": True, "10.0.0.1": True}
    for bad in ("1.2.3", "1.2.3.4.5", "1.2.3.x", "", "1..2.3", "99999999999999999999.1.1.1"):
        assert not spark.range(1).select(S.valid_ipv4(F.lit(bad))).first()[0]


def test_feedback_features(spark, tmp_path):
    features = {f: 1.5 for f in ("total_frames", "total_bytes", "duration", "avg_pkt_size", "pkts_per_sec", "bytes_per_sec", "protocol")}
    line = lambda n, decision, **f: dict(event="analyst_feedback", decision=decision, alert_id=uid(n), decision_timestamp="t",
                                         alert=dict(id=uid(n), model_features={**features, **f}))
    short = line(3, "ignored")
    del short["alert"]["model_features"]["duration"]
    lines = [line(1, "RESOLVED"), line(2, "ignored", protocol="17"), short, line(4, "ignored", duration=None),
             line(5, "resolved", duration="fast"), line(6, "pending"), dict(decision="ignored", alert_id=uid(7)), "{"]
    rows = readers.read_feedback(spark, write_lines(tmp_path, "f.jsonl", lines))
    got = {r["alert_id"]: (r["label"], r["duration"], r["protocol"]) for r in training.feedback_samples(rows).collect()}
    assert got == {uid(1): (1, 1.5, 1.5), uid(2): (0, 1.5, 17.0), uid(3): (0, 0.0, 1.5)}
    assert training.feedback_samples(rows, cap=2).count() == 2


def test_feedback_is_taken_whole(spark):
    features = F.create_map(F.lit("duration"), F.col("id").cast("string"))
    rows = spark.range(0, 100_002, 1, 4).select(
        F.col("id").cast("string").alias("alert_id"), F.when(F.col("id") % 3 == 0, "ignored").otherwise("resolved").alias("decision"),
        F.lit("t").alias("decision_timestamp"), F.struct(features.alias("model_features")).alias("alert"))
    got = training.feedback_samples(rows).agg(F.count("*"), F.countDistinct("alert_id"), F.sum("label"), F.max("duration")).first()
    assert tuple(got) == (100_002, 100_002, 66_668, 100_001.0)


def test_rule_files_are_ordered_by_path_and_line(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.rules").write_text('alert tcp any any -> any 2 (msg:"c";)\nalert tcp any any -> any 3 (msg:"d";)\n')
    (tmp_path / "a.rules").write_text('alert tcp any any -> any 1 (msg:"a";)\n\nalert tcp any any -> any 9 (msg:"b";)\n')
    (tmp_path / "note.txt").write_text('alert tcp any any -> any 1 (msg:"no";)\n')
    got = readers.read_rules(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["name"] for r in got] == ["a", "b", "c", "d"]


def test_c2_feed_as_one_document(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([dict(ip_address=" 1.1.1.1 ", malware="M", port=443), dict(ip_address="")], indent=1))
    got = readers.read_feed_c2(spark, str(tmp_path / "f.json"), multi_line=True).collect()
    assert [(r["ip"], r["malware"], r["port"], r["country"]) for r in got] == [("1.1.1.1", "M", "443", "")]


def test_csv_flows_are_numeric(spark, tmp_path):
    (tmp_path / "x.csv").write_text("PROTOCOL,IN_BYTES,IN_PKTS,OUT_BYTES,OUT_PKTS,FLOW_DURATION_MILLISECONDS,Label,Extra\n6,10,oops,5,,0,2,z\n17,0,0,0,0,500,,z\n")
    rows = training.training_features(readers.read_flow_csv(spark, str(tmp_path))).collect()
    got = sorted((r["protocol"], r["total_frames"], r["total_bytes"], round(r["duration"], 6), r["label"]) for r in rows)
    assert got == [(6.0, 0.0, 15.0, 0.001, 1), (17.0, 0.0, 0.0, 0.5, 0)]


def test_scratch_folder_is_new_for_every_use(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
