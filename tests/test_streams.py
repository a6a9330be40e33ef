import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import cascade, flows, intel, rules as R
from flowsentry.operators.thresholds import LOGIN_SERVICES, SynFlood
from flowsentry.plans import inputs as I
from flowsentry.plans.streams import run_in_batches
from flowsentry.sources import readers
from flowsentry.streaming import jobs, keyed
from tests.conftest import SF, SF_SMALL

SECOND = 1_000_000
CUTS = [0, 700 * SECOND, 1_300 * SECOND, 10_000 * SECOND]


def feed(spark, rows, path, job, cuts=CUTS):
    """One micro-batch per time range, each written and processed after the other."""
    for low, high in zip(cuts, cuts[1:]):
        rows.where((F.col("t_us") >= low) & (F.col("t_us") < high)).write.mode("append").parquet(path)
        job.start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()
    job.finish()


def test_cascade_in_several_batches_equals_one_batch(spark, tmp_path):
    # Cuts inside a burst: 13 half days are 650 s, and a burst lasts about two seconds.
    cuts = [0, 651 * SECOND, 652 * SECOND, 10_000 * SECOND]
    packets, bad, rules = I.packets(spark, SF), I.indicators(spark, SF), I.cascade_rules(spark, SF)
    job = jobs.CascadeStream(spark, str(tmp_path / "job"), 300_000, bad, rules)
    feed(spark, packets, str(tmp_path / "in"), job, cuts)
    columns = ["id", "type", "score", "ml_score", "model_features"]
    got = job.alerts().select(*columns)
    want = cascade.run_cascade(packets, bad, rules).select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert job.late_rows().isEmpty()


def test_flow_sessions_survive_batch_borders_and_restarts(spark, tmp_path):
    packets = I.packets(spark, SF_SMALL)
    for low, high in zip(CUTS, CUTS[1:]):
        # A new job on the same folder each time: all it knows is Spark's checkpoint.
        job = jobs.FlowFeatureStream(spark, str(tmp_path / "job"), 100 * SECOND)
        packets.where((F.col("t_us") >= low) & (F.col("t_us") < high)).write.mode("append").parquet(str(tmp_path / "in"))
        job.start(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))).awaitTermination()
    job.finish()
    columns = ["event_id", "session_start_us", "total_frames", "total_bytes"]
    want = {tuple(r) for r in flows.running_flows(packets).select(*columns).collect()}
    assert {tuple(r) for r in job.features().select(*columns).collect()} == want
    assert job.features().count() == len(want)


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    packets = I.packets(spark, SF_SMALL)
    flagged = intel.ioc_match(packets, I.indicators(spark, SF_SMALL))
    job = jobs.ThresholdStream(spark, str(tmp_path / "job"), 100 * SECOND)
    path = str(tmp_path / "in")
    for part in (flagged.where("t_us >= 1000000000"), flagged.where("t_us < 1000000000")):
        part.write.mode("append").parquet(path)
        job.start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()
    early = flagged.where("t_us < 1000000000").count()
    assert job.late_rows().count() == early > 0


def test_first_batch_without_rows_and_rows_without_time(spark, tmp_path):
    packets = I.packets(spark, SF_SMALL)
    timeless = packets.limit(5).withColumn("t_us", F.lit(None).cast("long"))
    job = jobs.FlowFeatureStream(spark, str(tmp_path / "job"), 100 * SECOND)
    for part in (packets.limit(0), packets.where("t_us < 1000000000").unionByName(timeless)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        job.start(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))).awaitTermination()
    job.finish()
    assert job.late_rows().count() == 5
    assert job.features().count() == packets.where("t_us < 1000000000").count()


def test_json_event_stream_drops_broken_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text(
        '{"event_id": 1, "ts": "2026-01-01T00:00:00Z", "src": "1.1.1.1", "dest_ip": "2.2.2.2", "proto": "tcp", "bytes": 7}\n{broken\n\n'
    )
    events = readers.stream_flow_events(spark, str(tmp_path / "in"))
    query = events.writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("parsed").select("src_ip", "dst_ip", "dst_port", "proto", "packet_size", "in_bytes").collect()
    assert rows == [("1.1.1.1", "2.2.2.2", 0, "TCP", 7, 7.0)]


def test_recent_blocks_keep_one_row_per_source(spark, tmp_path):
    rows = spark.range(20).select(
        F.concat(F.lit("10.0.0."), (F.col("id") % 4).cast("string")).alias("src_ip"),
        F.timestamp_seconds(F.col("id")).alias("ts"),
        F.when(F.col("id") % 4 == 3, "xgboost_anomaly").otherwise("signature:x").alias("type"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.recent_blocks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour")
    query = stream.writeStream.format("memory").queryName("blocks").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["src_ip"] for r in spark.table("blocks").collect()) == ["10.0.0.0", "10.0.0.1", "10.0.0.2"]


def test_rules_can_be_empty(spark):
    packets = I.packets(spark, SF_SMALL)
    none = R.builtin_rules(spark).where("1 = 0")
    assert R.first_rule_match(packets, none).where("rule is not null").isEmpty()


def test_alert_minutes_are_written_once_over_restarts(spark, tmp_path):
    path, source = str(tmp_path / "minutes"), str(tmp_path / "in")
    alerts = spark.range(600).select(
        F.lit("10.0.0.1").alias("src_ip"), F.lit("t").alias("type"), F.lit("pending").alias("status"),
        F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 7 / 7.0).alias("score"),
    )
    for part in (alerts.where("id < 300"), alerts.where("id >= 300")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(alerts.schema).parquet(source)
        jobs.write_alert_minutes(stream, path, "5 minutes").awaitTermination()
        jobs.write_alert_minutes(stream, path, "5 minutes").awaitTermination()
    for _ in range(2):
        jobs.close_alert_minutes(stream, path, "5 minutes")
    rows = jobs.read_alert_minutes(spark, path)
    assert (rows.count(), rows.agg(F.sum("count")).first()[0]) == (100, 600)


def test_texts_are_read_of_equal_rows_only(monkeypatch):
    rows = pd.DataFrame({"t_us": [3, 1, 2, 1], "event_id": [7, 9, 7, 8], "row": ["no json"] * 4})
    ordered = keyed.one_of_each(rows)
    assert list(zip(ordered["t_us"], ordered["event_id"])) == [(1, 8), (1, 9), (2, 7), (3, 7)]
    # Of equal ones with an id the least text stays, ids made from content get ranks; a source counts for itself.
    a, b, c = ('{"src_ip":"a","n":1}', '{"src_ip":"a","n":2}', '{"src_ip":"b"}')
    rows = pd.DataFrame({"t_us": [5, 5, 5, 5, 4, 5], "event_id": [1, 1, 1, -8, 6, -8], "row": [b, a, c, a, "no json", a]})
    ordered = keyed.one_of_each(rows)
    got = list(zip(ordered["t_us"], ordered["event_id"], ordered["row"]))
    assert got == [(4, 6, "no json"), (5, -8, a), (5, -8 ^ 1, a), (5, 1, a), (5, 1, c)]


def test_large_keys_hand_their_state_over_a_few_times_and_small(spark, tmp_path):
    text = '{"t_us":%d,"src_ip":"10.0.0.1","dst_ip":"192.168.1.1","src_port":1024,"dst_port":22,"proto":"TCP","flags":"S"}'
    rows = pd.DataFrame({"t_us": range(20_000), "event_id": range(20_000), "row": [text % n for n in range(20_000)]})
    packed = keyed.pack(rows)
    assert len(packed) < rows["row"].str.len().sum() / 4 and keyed.unpack(packed).equals(rows)
    packets = I.packets(spark, SF_SMALL)
    packets.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(keyed.BATCH_SETTING)
    job = jobs.FlowFeatureStream(spark, str(tmp_path / "job"), 100 * SECOND)
    query = job.start(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")))
    query.awaitTermination()
    assert spark.conf.get(keyed.BATCH_SETTING) == before != str(keyed.BATCH_ROWS)
    plan = query._jsq.explainInternal(False)
    # Released rows are parsed and written by all tasks, each text once.
    assert plan.count("Generate inline") == 1 and plan.index("REPARTITION_BY_COL") < plan.index("FlatMapGroupsInPandasWithState")


def test_state_lies_in_a_few_partitions_for_each_core(spark, tmp_path):
    packets = I.packets(spark, SF_SMALL)
    packets.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get(keyed.PARTITION_SETTING)
    most = max(keyed.LEAST_PARTITIONS, keyed.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    for asked, got in (("60", most), ("3", 3)):
        spark.conf.set(keyed.PARTITION_SETTING, asked)
        try:
            job = jobs.FlowFeatureStream(spark, str(tmp_path / asked), 100 * SECOND)
            job.start(events).awaitTermination()
            assert spark.conf.get(keyed.PARTITION_SETTING) == asked
        finally:
            spark.conf.set(keyed.PARTITION_SETTING, before)
        job.finish()  # under another setting: Spark keeps the number of the first start
        parts = [p.name for p in (tmp_path / asked / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
        assert len(parts) == got
        assert job.features().count() == packets.count()


def test_rows_are_made_once_for_all_batches(spark, tmp_path):
    made, seen = spark.sparkContext.accumulator(0), []

    @F.udf("long")
    def time(n):
        made.add(1)
        return None if n == 3 else 1000 * n if n < 5 else 100_000 + n

    class Job:
        def start(self, events):
            writer = events.writeStream.foreachBatch(lambda rows, _: seen.append(sorted(r["id"] for r in rows.collect())))
            return writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()

        def finish(self):
            seen.append("end")

    rows = spark.range(10).select("id", time.asNondeterministic()("id").alias("t_us"))
    run_in_batches(spark, Job(), rows, 4)
    assert seen == [[0, 1, 2, 4], [], [], [5, 6, 7, 8, 9], "end"]
    # Once for the first and last time, once for all batches.
    assert made.value == 20


class State:
    """What ``applyInPandasWithState`` gives a key's function."""

    def __init__(self):
        self.get, self.watermark, self.hasTimedOut = None, 0, False

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.watermark // 1000

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        assert at > 0


def source_events(n=6_000, seed=3):
    """Packets of one source: bursts, some at the same moment, some twice, ids of content among them."""
    rnd = np.random.default_rng(seed)
    t = np.sort(rnd.integers(0, 900, n)) * SECOND + rnd.integers(0, 3, n)
    rows = pd.DataFrame({"key": "k", "t_us": t, "event_id": rnd.permutation(n).astype(np.int64)})
    rows.loc[rnd.random(n) < 0.1, "event_id"] = -5
    rows["t_us"] = rows["t_us"].where(rnd.random(n) > 0.01, keyed.NO_TIME)
    rows["row"] = [json.dumps({"src_ip": "ab"[i % 5 == 0], "n": i % 9}) for i in range(n)]
    rows["size"], rows["record"], rows["syn"] = rnd.integers(40, 900, n) / 1.0, rnd.random(n) < 0.1, rnd.random(n) < 0.7
    rows["port"] = rnd.choice([21, 22, 3389, 80], n).astype(np.int32)
    rows["signed"], rows["named"] = np.arange(n) > 2_000, True
    rows["flow"] = rnd.choice(["f", "g", "h"], n)
    return pd.concat([rows, rows.sample(400, random_state=1)]).sample(frac=1, random_state=2).reset_index(drop=True)


def run_source(job, rows, cuts=(350 * SECOND, 650 * SECOND), batch=1_500):
    """(what packing, the key's task and opening give, late rows in it, most rows and blocks handed to the key at once)."""
    schema = pa.Schema.from_pandas(rows, preserve_index=False)
    pack, run, reopen = keyed.in_blocks(job.facts), keyed.in_order(job.rules(), job.facts, job.results), keyed.opened(job.results)
    state, out, handed = State(), [], 0
    # Some rows come 300 s after their time: those are late or just not yet.
    comes = rows["t_us"].clip(lower=0) + 300 * SECOND * (rows.index % 20 == 0)
    edges = [0, *cuts, 1 << 62]
    for low, high in zip(edges, edges[1:]):
        part = rows[(comes >= low) & (comes < high)]
        batches = [pa.RecordBatch.from_pandas(part.iloc[a : a + batch], schema, preserve_index=False) for a in range(0, len(part), batch)]
        parts = [b.to_pandas() for b in pack(iter(batches))]
        handed = max(handed, sum(map(len, parts)))
        out += list(run(("k",), iter(parts), state))
        state.watermark, state.hasTimedOut = high - 100 * SECOND, True
        out += list(run(("k",), iter(()), state))
        state.hasTimedOut = False
    kept = pa.schema([("event_id", pa.int64()), ("row", pa.string()), ("late", pa.bool_()),
                      *((n, keyed.ARROW[k]) for n, k in job.results.items()), ("texts", pa.binary()), ("packed", pa.binary())])
    opened = reopen(pa.RecordBatch.from_pandas(o[kept.names], kept, preserve_index=False) for o in out if len(o))
    columns = ["late", "event_id", "row", *job.results]
    got = pa.Table.from_batches(opened).select(columns).to_pylist()
    return sorted(map(repr, got)), sum(r["late"] for r in got), handed


@pytest.mark.parametrize("release", [10**9, 700])
@pytest.mark.parametrize("kind", ["cascade", "flows"])
def test_blocks_give_what_single_rows_give(spark, monkeypatch, kind, release):
    if kind == "cascade":
        job = jobs.ThresholdStream(spark, "", SECOND, cascade.CascadeConfig(mode="block-signature", syn=SynFlood(), services=LOGIN_SERVICES))
    else:
        job = jobs.FlowFeatureStream(spark, "", SECOND)
    rows = source_events()
    rows = rows[["key", "t_us", "event_id", "row", *job.facts]]
    want, late, handed = run_source(job, rows)
    assert 150 < late < len(rows) / 4 and handed < 600  # in blocks
    assert sum(r.count("'late': True") for r in want) == late
    monkeypatch.setattr(keyed, "LEAST_BLOCK", 10**9)
    alone, late_alone, all_rows = run_source(job, rows)
    assert (alone, late_alone) == (want, late) and all_rows > 1_500
    # Other sizes, some batches with too few rows for a block, and stretches that hold a part of what is released.
    monkeypatch.setattr(keyed, "LEAST_BLOCK", 40)
    monkeypatch.setattr(keyed, "BLOCK_ROWS", 64)
    monkeypatch.setattr(keyed, "RELEASE_ROWS", release)
    assert run_source(job, rows, batch=901)[0] == want


def test_a_large_key_is_handed_over_in_blocks(spark):
    job = jobs.ThresholdStream(spark, "", SECOND)
    rows = source_events(40_000)[["key", "t_us", "event_id", "row", *job.facts]]
    others = rows.head(2_000).assign(key=[f"k{i // 100}" for i in range(2_000)])
    batch = pa.RecordBatch.from_pandas(pd.concat([rows, others]), preserve_index=False)
    parts = [b.to_pandas() for b in keyed.in_blocks(job.facts)(iter([batch]))]
    found = pd.concat(parts)
    assert (found["key"] == "k").sum() == 3 and (found["packed"].notna() == (found["key"] == "k")).all()
    assert sum(keyed.Block(b).rows for b in found["packed"].dropna()) == len(rows) and (found["key"] != "k").sum() == 2_000
