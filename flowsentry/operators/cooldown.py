"""Alert cooldown: per key, keep a candidate only if the last kept one is at least the cooldown away.

The rule is greedy and therefore sequential along a key. All candidates are dealt out by ranges of (key, time), so
partitions are of equal size whatever the keys. Within a partition times are jumped through in order. Only the key a
partition begins with may have begun before: for it the partition gives a map from "earliest time an alert is allowed"
to "last alert kept here". Maps of neighbouring partitions are combined by 64, level by level, and what is allowed at
the start of each is handed down again; the partition's own alerts follow from that.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import materialize

#: Two to this power maps are combined at a time.
FAN_BITS = 6

#: Kinds of rows a partition gives: an alert, the times of its first key, and a map.
KEPT, WAITING, MAP = range(3)
PARTS = "kind int, key string, cd long, pos long, t_us long, times binary, upto binary, last binary"
NODE = "key string, cd long, pos long, upto binary, last binary"
ENTER = "key string, pos long, allowed long"
FIRST, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def keep_after_cooldown(
    candidates: DataFrame,
    keys: list[str],
    cooldown_us: Column,
    last_alerts: DataFrame | None = None,
) -> DataFrame:
    """Kept candidates. ``cooldown_us`` must be constant within a key.

    ``last_alerts`` (keys, last_us) continues from alerts raised earlier. Of candidates with equal times only
    the lowest event id can be kept, so ties are merged before anything is shuffled by key.
    """
    columns = candidates.columns
    payload = [c for c in columns if c not in keys and c != "t_us"]
    timed = candidates.withColumn("_cd", cooldown_us.cast("long"))
    if last_alerts is not None:
        timed = (
            timed.join(last_alerts.select(*keys, "last_us"), keys, "left")
            .where(F.col("last_us").isNull() | (F.col("t_us") - F.col("last_us") >= F.col("_cd")))
            .drop("last_us")
        )
    body = F.struct("event_id", *[c for c in payload if c != "event_id"])
    ticks = timed.groupBy(*keys, "_cd", "t_us").agg(F.min(body).alias("_body"))
    # Written once: the times are read here, the alerts' own columns at the end.
    ticks = materialize(ticks.withColumn("_key", F.to_json(F.struct(*keys))), "candidates")
    times = kept_times(ticks.select(F.col("_key").alias("key"), F.col("_cd").alias("cd"), "t_us"))
    kept = ticks.join(times.select(F.col("key").alias("_key"), "t_us"), ["_key", "t_us"])
    # Alerts are few, and later stages read them again and again.
    return materialize(kept.select(*keys, "t_us", *[F.col(f"_body.{c}").alias(c) for c in payload]).select(*columns), "kept-alerts")


def kept_times(ticks: DataFrame) -> DataFrame:
    """(key, t_us) of the candidates that are kept; ``ticks`` is (key, cd, t_us) without repeated rows."""
    order = ["key", "t_us"]
    parts = materialize(ticks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_partition, PARTS), "cooldown-parts")
    levels = [parts.where(F.col("kind") == MAP).select("key", "cd", "pos", "upto", "last")]
    highest = levels[0].agg(F.max("pos")).first()[0] or 0
    for _ in range(max(0, -(-highest.bit_length() // FAN_BITS) - 1)):
        together = levels[-1].repartition("key", F.shiftright("pos", FAN_BITS)).sortWithinPartitions("key", "pos")
        levels.append(materialize(together.mapInArrow(partial(_combined, FAN_BITS), NODE), "cooldown-maps"))
    # At the top a key is one group, and nothing is known before it.
    enter = None
    for level in reversed(levels):
        both = level.withColumn("group", F.shiftright("pos", FAN_BITS))
        if enter is not None:
            above = enter.select("key", F.col("pos").alias("group"), F.lit(int(FIRST)).alias("pos"), "allowed")
            both = above.unionByName(both, allowMissingColumns=True)
        both = both.repartition("key", "group").sortWithinPartitions("key", "group", "pos")
        enter = both.mapInArrow(_handed_down, ENTER)
        enter = enter if level is levels[0] else materialize(enter, "cooldown-entries")
    waiting = parts.where(F.col("kind") == WAITING).select("key", "cd", "pos", "times").join(enter, ["key", "pos"])
    return parts.where(F.col("kind") == KEPT).select("key", "t_us").unionByName(waiting.mapInArrow(_picked, "key string, t_us long"))


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8")


def _partition(batches):
    """PARTS of one partition. A place is twice the partition's number, and one more for the last key's."""
    place = TaskContext.get().partitionId() * 2
    now, cd, first, held, allowed = None, 0, True, [], FIRST

    def opening():
        times = np.concatenate(held)
        upto, last = entry_map(times, int(times[0]), cd)
        packed = [x.astype("<i8").tobytes() for x in (times, upto, last)]
        return [(WAITING, now, cd, place, None, packed[0], None, None), (MAP, now, cd, place, None, None, *packed[1:])]

    for batch in batches:
        keys, cds, times = batch["key"], batch["cd"].to_numpy(), batch["t_us"].to_numpy()
        ends = keys.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(times)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = keys[a].as_py()
            if now is None:
                now, cd = key, int(cds[a])
            elif key != now:
                if first:
                    out += opening()
                now, cd, first, held, allowed = key, int(cds[a]), False, [], FIRST
            if first:
                held.append(times[a:b])
            else:
                kept = greedy(times[a:b], allowed, cd)
                allowed = int(kept[-1]) + cd if len(kept) else allowed
                out += [(KEPT, now, cd, None, t, None, None, None) for t in kept.tolist()]
        yield _batch(out, PARTS)
    if now is not None:
        if first:
            yield _batch(opening(), PARTS)
        else:
            # The key goes on in the next partition from its last alert here, whatever came before.
            always, last = (np.array([x], "<i8").tobytes() for x in (NEVER, allowed - cd))
            yield _batch([(MAP, now, cd, place + 1, None, None, always, last)], PARTS)


def _combined(bits, batches):
    """NODE of the maps of each key whose places differ in the last ``bits`` bits only; two maps are held at a time."""
    group, cd, upto, last, start = None, 0, None, None, 0
    for batch in batches:
        for r in batch.to_pylist():
            mine = (r["key"], r["pos"] >> bits)
            if mine != group:
                if group is not None:
                    yield _batch([(group[0], cd, group[1], upto.astype("<i8").tobytes(), last.astype("<i8").tobytes())], NODE)
                group, cd, upto, last = mine, r["cd"], _longs(r["upto"]), _longs(r["last"])
                start = int(upto[0])
            else:
                upto, last = combine_maps([(0, upto, last), (1, _longs(r["upto"]), _longs(r["last"]))], start, cd)
    if group is not None:
        yield _batch([(group[0], cd, group[1], upto.astype("<i8").tobytes(), last.astype("<i8").tobytes())], NODE)


def _handed_down(batches):
    """ENTER of each map: what is allowed at its start. What is allowed at the start of a group comes first, if known."""
    group, allowed = None, FIRST
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["key"], r["group"]) != group:
                group, allowed = (r["key"], r["group"]), FIRST
            if r["pos"] == FIRST:
                allowed = r["allowed"]
                continue
            out.append((r["key"], r["pos"], int(allowed)))
            upto = _longs(r["upto"])
            at = np.searchsorted(upto, allowed)
            if at < len(upto):
                allowed = int(_longs(r["last"])[at]) + r["cd"]
        yield _batch(out, ENTER)


def _picked(batches):
    for batch in batches:
        for r in batch.to_pylist():
            kept = greedy(_longs(r["times"]), r["allowed"], r["cd"])
            yield _batch([(r["key"], t) for t in kept.tolist()], "key string, t_us long")


def _merge_runs(upto: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(upto) < 2:
        return upto, last
    run_end = np.append(last[1:] != last[:-1], True)
    return upto[run_end], last[run_end]


def entry_map(times: np.ndarray, start: int, cd: int) -> tuple[np.ndarray, np.ndarray]:
    """Block map: an alert allowed from ``a <= upto[i]`` (and above ``upto[i-1]``) on leads to ``last[i]``."""
    # An alert before the block allows the next one before start + cd, so later entries need only the first time.
    upto = times[: np.searchsorted(times, start + cd) + 1]
    last = upto.copy()
    while True:
        following = np.searchsorted(times, last + cd)
        going_on = following < len(times)
        if not going_on.any():
            return _merge_runs(upto, last)
        last = np.where(going_on, times[np.minimum(following, len(times) - 1)], last)


def combine_maps(maps, start: int, cd: int) -> tuple[np.ndarray, np.ndarray]:
    """One map for consecutive blocks."""
    upto = last = np.empty(0, dtype=np.int64)
    for _, block_upto, block_last in maps:
        at = np.searchsorted(block_upto, last + cd)
        inside = at < len(block_upto)
        last = np.where(inside, block_last[np.minimum(at, len(block_last) - 1)], last)
        if len(upto) == 0 or upto[-1] < start + cd:
            fresh = block_upto > upto[-1] if len(upto) else np.ones(len(block_upto), dtype=bool)
            upto, last = np.append(upto, block_upto[fresh]), np.append(last, block_last[fresh])
        upto, last = _merge_runs(upto, last)
    return upto, last


def walk_maps(maps, enter: int | None, cd: int) -> list[tuple[int, int]]:
    """Earliest allowed time at the start of every block, in order."""
    allowed = np.iinfo(np.int64).min if enter is None else enter
    steps = []
    for order, upto, last in maps:
        steps.append((order, int(allowed)))
        at = np.searchsorted(upto, allowed)
        if at < len(upto):
            allowed = last[at] + cd
    return steps


def greedy(times: np.ndarray, allowed: int, cd: int) -> np.ndarray:
    kept = []
    at = np.searchsorted(times, allowed)
    while at < len(times):
        kept.append(times[at])
        at = np.searchsorted(times, times[at] + cd)
    return np.array(kept, dtype=np.int64)


def first_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Earliest row per key (empty keys skipped); a plain aggregation, so it combines before the shuffle."""
    body = F.struct(*[F.col(c) for c in rows.columns if c != key])
    order = F.struct("t_us", "event_id")
    firsts = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min_by(body, order).alias("_row"))
    return firsts.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
