import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import cooldown, dense, flows, thresholds
from tests import reference_model as model

S = 1_000_000


def packets(spark, rows):
    base = dict(src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=1, dst_port=80, proto="TCP", flags="S", packet_size=100)
    full = [{**base, "event_id": i, **r} for i, r in enumerate(rows)]
    schema = (
        "event_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, flags string, "
        "packet_size long"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema), full


@pytest.mark.parametrize("block_us", [7 * S, 100 * S, 600 * S])
def test_running_flows_match_a_sequential_pass_for_any_block_length(spark, block_us):
    rnd = random.Random(block_us)
    rows = []
    for src in range(3):
        t = 0
        for _ in range(150):
            t += rnd.choice([0, S, 20 * S, 119 * S, 120 * S, 120 * S + 1, 300 * S])
            rows.append(dict(t_us=t, src_ip=f"10.0.0.{src}", packet_size=rnd.randint(0, 900)))
    df, full = packets(spark, rows)
    got = flows.running_flows(df, block_us=block_us).collect()
    want = model.running_flows(full)
    assert {r["event_id"]: (r["session_start_us"], r["total_frames"], r["total_bytes"]) for r in got} == want


def test_open_sessions_continue(spark):
    df, full = packets(spark, [dict(t_us=i * 50 * S, packet_size=i) for i in range(20)])
    early, late = df.where("event_id < 7"), df.where("event_id >= 7")
    last = flows.running_flows(early).orderBy(F.desc("t_us")).limit(1)
    carry = last.select(*flows.FLOW_KEY, "t_us", F.col("total_frames").alias("frames"), F.col("total_bytes").alias("bytes"),
                        F.col("session_start_us").alias("first_us"))
    got = flows.running_flows(late, open_sessions=carry).collect()
    want = model.running_flows(full)
    assert {r["event_id"]: (r["session_start_us"], r["total_frames"], r["total_bytes"]) for r in got} == {
        k: v for k, v in want.items() if k >= 7
    }


def syn_hits(spark, times):
    df, _ = packets(spark, [dict(t_us=t) for t in times])
    return sorted(r["event_id"] for r in thresholds.syn_flood(df.select("src_ip", "t_us", "event_id")).collect())


def test_syn_flood_needs_thirty_within_three_seconds_inclusive(spark):
    assert syn_hits(spark, [0] * 29) == []
    assert syn_hits(spark, [0] * 30) == [29]
    assert syn_hits(spark, [0] + [3 * S] * 29) == [29]
    assert syn_hits(spark, [0] + [3 * S + 1] * 29) == []


def test_syn_flood_window_crosses_time_blocks(spark):
    edge = 60 * S
    assert syn_hits(spark, [edge - 2 * S] * 15 + [edge] * 15) == [29]


def test_syn_flood_cooldown_is_inclusive(spark):
    burst = [0] * 30
    assert syn_hits(spark, burst + [10 * S - 1] * 30) == [29]
    assert syn_hits(spark, burst + [10 * S] * 30) == [29, 59]


def test_login_severity_saturates(spark):
    def severity(n):
        df, _ = packets(spark, [dict(t_us=0, dst_port=3389)] * 4 + [dict(t_us=i, dst_port=22) for i in range(n)])
        hits = thresholds.login_candidates(thresholds.service_lookup(df.select("src_ip", "dst_port", "t_us", "event_id")))
        return [r["over"] for r in hits.orderBy("event_id").collect()]

    assert severity(5) == []
    assert severity(6) == [0]
    assert severity(13) == [0, 1, 2, 3, 4, 4, 4, 4]


@pytest.mark.parametrize("seed", range(6))
def test_block_maps_equal_a_sequential_cooldown(seed):
    rnd = np.random.default_rng(seed)
    cd = 10
    times = np.unique(rnd.integers(0, 5_000, [40, 400, 3_000][seed % 3]))
    length = cd * 2
    blocks = [(b, times[times // length == b]) for b in np.unique(times // length)]
    maps = [(int(b), *cooldown.entry_map(ts, int(b) * length, cd)) for b, ts in blocks]
    kept = [t for (b, enter), (_, ts) in zip(cooldown.walk_maps(maps, None, cd), blocks) for t in cooldown.greedy(ts, enter, cd)]
    assert kept == model.greedy(times.tolist(), cd)

    spans = {}
    for m in maps:
        spans.setdefault(m[0] // 4, []).append(m)
    span_maps = [(s, *cooldown.combine_maps(ms, s * 4 * length, cd)) for s, ms in sorted(spans.items())]
    by_block = dict(blocks)
    kept = []
    for s, enter in cooldown.walk_maps(span_maps, None, cd):
        for b, start in cooldown.walk_maps(spans[s], enter, cd):
            kept += list(cooldown.greedy(by_block[b], start, cd))
    assert kept == model.greedy(times.tolist(), cd)


def test_hot_keys_and_small_keys_keep_the_same_alerts(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("hot", rnd.randrange(0, 3_000 * S, S // 4), i) for i in range(6_000)]
    rows += [(f"k{i % 50}", rnd.randrange(0, 3_000 * S, S // 4), 6_000 + i) for i in range(2_000)]
    df = spark.createDataFrame(rows, "src_ip string, t_us long, event_id long")
    want = {}
    for key, t, i in rows:
        want.setdefault(key, []).append(t)
    want = sorted((k, t) for k, ts in want.items() for t in model.greedy(ts, 10 * S))
    ids = {(k, t): min(i for kk, tt, i in rows if (kk, tt) == (k, t)) for k, t in want}
    for bits in (1, 6):
        monkeypatch.setattr(cooldown, "FAN_BITS", bits)
        got = cooldown.keep_after_cooldown(df, ["src_ip"], F.lit(10 * S)).collect()
        assert sorted((r["src_ip"], r["t_us"]) for r in got) == want
        assert {(r["src_ip"], r["t_us"]): r["event_id"] for r in got} == ids


def test_cooldown_continues_from_earlier_alerts(spark):
    df = spark.createDataFrame([("a", 5 * S, 1), ("a", 12 * S, 2), ("b", 5 * S, 3)], "src_ip string, t_us long, event_id long")
    earlier = spark.createDataFrame([("a", 2 * S)], "src_ip string, last_us long")
    got = cooldown.keep_after_cooldown(df, ["src_ip"], F.lit(10 * S), last_alerts=earlier).collect()
    assert sorted(r["event_id"] for r in got) == [2, 3]


@pytest.mark.parametrize("parts", [1, 7])
def test_cooldown_over_partition_borders(spark, monkeypatch, parts):
    """One key over all partitions, dense and sparse, null keys, and cooldowns longer than a partition."""
    monkeypatch.setattr(cooldown, "FAN_BITS", 1)
    rnd = random.Random(parts)
    rows = [("a", rnd.randrange(0, 2_000), 7) for _ in range(3_000)] + [("b", rnd.randrange(0, 10**6), 5_000) for _ in range(900)]
    rows += [(None, t, 1) for t in range(0, 60, 3)] + [("c", 5, 10)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, t_us long, cd long, event_id long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * parts))
    got = cooldown.keep_after_cooldown(df, ["k"], F.col("cd")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [(k, t) for k, cd in (("a", 7), ("b", 5_000), (None, 1), ("c", 10)) for t in model.greedy([r[1] for r in rows if r[0] == k], cd)]
    assert sorted(((r["k"], r["t_us"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [40, 300])
def test_dense_blocks_are_cut_by_count(spark, monkeypatch, most):
    """A key whose rows nearly all lie at one time, or in one second, counts the same in blocks of few rows."""
    rnd = random.Random(most)
    times = [30 * S] * 400 + [31 * S + rnd.randrange(S) for _ in range(800)] + [rnd.randrange(90 * S) for _ in range(300)]
    rows = [("hot", t, i) for i, t in enumerate(times)] + [(f"k{i % 4}", rnd.randrange(20 * S), 2_000 + i) for i in range(300)]
    rows += [(None, t, 3_000 + t) for t in range(100)]
    df = spark.createDataFrame(rows, "src_ip string, t_us long, event_id long")
    cut = dense.cut_blocks(df, ["src_ip"], 60 * S, most)
    sizes = cut.groupBy("src_ip", "_blk", "_sub").agg(F.count("*").alias("n"), F.min(F.struct("t_us", "event_id")).alias("a"), F.max(F.struct("t_us", "event_id")).alias("b"))
    sizes = sizes.orderBy("src_ip", "_blk", "_sub").collect()
    assert max(r["n"] for r in sizes) <= 1.3 * most
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]) if x["src_ip"] == y["src_ip"])
    rule = thresholds.SynFlood(count=7, window_us=S // 50)
    want = {r["event_id"] for r in thresholds.syn_flood_candidates(df, rule, most=10**9).collect()}
    assert {r["event_id"] for r in thresholds.syn_flood_candidates(df, rule, most=most).collect()} == want
    brute = set()
    for key in {r[0] for r in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        brute |= {i for n, (t, i) in enumerate(mine) if n >= 6 and t - mine[n - 6][0] <= S // 50}
    assert want == brute and len(want) > 500


def test_running_flows_in_dense_blocks(spark):
    """One flow with most packets in one second or at one time, sessions that cross the cuts, and null key parts."""
    rnd = random.Random(11)
    times = [50 * S] * 500 + [700 * S + rnd.randrange(S) for _ in range(500)] + [rnd.randrange(2_000 * S) for _ in range(60)]
    rows = [dict(t_us=t, packet_size=rnd.randint(0, 900)) for t in times]
    rows += [dict(t_us=rnd.randrange(900 * S), src_ip=None, packet_size=3) for _ in range(200)]
    df, full = packets(spark, rows)
    want = model.running_flows(full)
    for most in (45, 10**9):
        got = flows.running_flows(df, most=most).collect()
        assert {r["event_id"]: (r["session_start_us"], r["total_frames"], r["total_bytes"]) for r in got} == want
        assert len(got) == len(want)
    a, b = (sorted(map(str, flows.flow_summary(df, most=most).collect())) for most in (45, 10**9))
    assert a == b
