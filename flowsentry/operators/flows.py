"""Event fields, flow sessions and running per-flow features.

A flow key may own a large part of all packets, so no window here spans a whole key. Packets are windowed per (flow,
block), blocks being cut by time and, where packets are dense, by count; what a block inherits from earlier blocks is
computed on one summary row per block and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions import scalars as S
from flowsentry.operators.dense import BLOCK_ROWS, cut_blocks, meet
from flowsentry.schemas import FLOW_KEY
from flowsentry.session import materialize

IDLE_GAP_US = 120_000_000
BLOCK_US = 600_000_000
#: Rows that are equal in these are one event.
IDENTITY = ["event_id", "t_us", "src_ip"]
#: Event columns that make a record a finished flow rather than a packet.
COUNTERS = ["in_pkts", "out_pkts", "in_bytes", "out_bytes", "duration_ms"]


def content_id(columns: list[str], rank: Column) -> Column:
    """Name of the event with this content and rank among its equals: negative, unlike any given id."""
    return F.bitwise_not(F.shiftrightunsigned(F.xxhash64(*columns), 1).bitwiseXOR(rank))


def event_time() -> Column:
    """Time of a JSON event: ``ts``, else ``timestamp`` as ISO text or as seconds since 1970."""
    seconds = F.col("timestamp").try_cast("double")
    return F.coalesce("ts", F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(S.parse_iso(F.col("timestamp"))))


def event_fields(events: DataFrame) -> DataFrame:
    """Normalised event columns from JSON-shaped events: alternative keys, defaults, upper-case protocol."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("0.0.0.0"))
    number = lambda name, kind: F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind))
    size = number("bytes", "long")
    in_bytes = number("IN_BYTES", "double")
    return events.select(
        "event_id",
        F.unix_micros(event_time() if "timestamp" in events.columns else F.col("ts")).alias("t_us"),
        first("src_ip", "src").alias("src_ip"),
        first("dest_ip", "dest").alias("dst_ip"),
        number("src_port", "int").alias("src_port"),
        number("dest_port", "int").alias("dst_port"),
        F.upper(S.text_or(F.col("proto"), "OTHER")).alias("proto"),
        F.coalesce("tcp_flags", F.lit("")).alias("flags"),
        size.alias("packet_size"),
        number("IN_PKTS", "double").alias("in_pkts"),
        number("OUT_PKTS", "double").alias("out_pkts"),
        F.when(in_bytes != 0, in_bytes).otherwise(size.cast("double")).alias("in_bytes"),
        number("OUT_BYTES", "double").alias("out_bytes"),
        number("FLOW_DURATION_MILLISECONDS", "double").alias("duration_ms"),
    )


def unique_events(events: DataFrame) -> DataFrame:
    """One row for each event; of rows equal in IDENTITY the least by their other columns.

    Only ids are counted over all rows. Without a repeated id the table is returned as it is; else only the rows with
    one meet each other.
    """
    repeated = events.groupBy(F.col("event_id").alias("_again")).count().where("count > 1").select("_again")
    if repeated.isEmpty():
        return events
    repeated = materialize(repeated, "repeated-ids")
    several = F.col("event_id").eqNullSafe(F.col("_again"))
    rest = [c for c in events.columns if c not in IDENTITY]
    merged = events.join(repeated, several, "left_semi").groupBy(*IDENTITY).agg(F.min(F.struct(*rest)).alias("_rest"))
    merged = merged.select(*[F.col(c) if c in IDENTITY else F.col(f"_rest.{c}").alias(c) for c in events.columns])
    return materialize(events.join(repeated, several, "left_anti").unionByName(merged), "unique-events")


def with_ratios(df: DataFrame, clamp_frames: bool = True) -> DataFrame:
    """Average size and rates from ``total_frames``, ``total_bytes`` and ``duration`` (seconds)."""
    frames, size, duration = F.col("total_frames"), F.col("total_bytes"), F.col("duration")
    per_frame = F.greatest(frames, F.lit(1.0))
    return df.withColumns(
        {
            "avg_pkt_size": size / per_frame,
            "pkts_per_sec": (per_frame if clamp_frames else frames) / duration,
            "bytes_per_sec": size / duration,
        }
    )


def flow_record_features(records: DataFrame) -> DataFrame:
    """Features of events that carry their own flow counters."""
    return with_ratios(
        records.withColumns(
            {
                "total_frames": F.greatest(F.col("in_pkts") + F.col("out_pkts"), F.lit(1.0)),
                "total_bytes": F.greatest(F.col("in_bytes") + F.col("out_bytes"), F.lit(0.0)),
                "duration": F.greatest(F.col("duration_ms") / 1000.0, F.lit(0.001)),
            }
        )
    )


BLOCK = [*FLOW_KEY, "_blk", "_sub"]


def running_flows(
    packets: DataFrame,
    gap_us: int = IDLE_GAP_US,
    block_us: int = BLOCK_US,
    open_sessions: DataFrame | None = None,
    most: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``session_start_us``, ``total_frames`` and ``total_bytes`` so far to every packet.

    A session ends when the flow is idle for more than ``gap_us``. ``open_sessions`` (flow key, t_us = last
    packet, first_us, frames, bytes) continues sessions of an earlier slice of the same stream.

    Sums run within a block first; the blocks' totals are then summed along each flow, and what a block inherits is
    added to its first session. Rows that ``dense.cut_blocks`` has cut already are taken as they are.
    """
    frames, size, first = F.lit(1.0), F.col("packet_size").cast("double"), F.col("t_us")
    rows, columns = packets, [c for c in packets.columns if c not in BLOCK[-2:]]
    if open_sessions is not None:
        prior = open_sessions.select(
            *FLOW_KEY,
            "t_us",
            F.col("frames").alias("_frames"),
            F.col("bytes").alias("_bytes"),
            F.col("first_us").alias("_first"),
        )
        # An open session is one row that stands for all its packets; ``_frames`` is null on real packets.
        rows = packets.unionByName(prior, allowMissingColumns=True)
        frames, size, first = F.coalesce("_frames", frames), F.coalesce("_bytes", size), F.coalesce("_first", first)
    if "_sub" not in rows.columns:
        rows = cut_blocks(rows, FLOW_KEY, block_us, most)

    in_block = Window.partitionBy(*BLOCK).orderBy("t_us", "event_id")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = lambda value: F.last(F.when(F.col("_cut"), value), ignorenulls=True).over(so_far)
    local = (
        rows.withColumns(
            {
                "_cut": F.coalesce(F.col("t_us") - F.lag("t_us").over(in_block) > gap_us, F.lit(False)),
                "_cum_f": F.sum(frames).over(so_far),
                "_cum_b": F.sum(size).over(so_far),
                "_blk_first_t": F.first("t_us").over(so_far),
                "_blk_first": F.first(first).over(so_far),
                "_blk_end": F.lead("t_us").over(in_block).isNull(),
            }
        )
        .withColumns(
            {
                "_cut_f": cut(F.col("_cum_f") - frames),
                "_cut_b": cut(F.col("_cum_b") - size),
                "_cut_t": cut(first),
            }
        )
        .withColumns(
            {
                "_head": F.col("_cut_t").isNull(),
                "_f": F.col("_cum_f") - F.coalesce("_cut_f", F.lit(0.0)),
                "_b": F.col("_cum_b") - F.coalesce("_cut_b", F.lit(0.0)),
                "_start": F.coalesce("_cut_t", "_blk_first"),
            }
        )
    )
    kept = [*columns, *BLOCK[-2:], "_blk_first_t", "_blk_end", "_head", "_f", "_b", "_start"]
    # Written, so that the blocks' totals and the rows come from one pass over the windows.
    local = materialize(local.select(*kept, *(["_frames"] if open_sessions is not None else [])), "flow-blocks")

    # One summary row per block; time blocks that can neither give nor take a session are left out.
    opens_early = F.col("_blk_first_t") - F.col("_blk") * block_us <= gap_us
    closes_late = (F.col("_blk") + 1) * block_us - F.col("t_us") <= gap_us
    by_flow = Window.partitionBy(*FLOW_KEY).orderBy("_blk", "_sub")
    ends = local.where(F.col("_blk_end")).select(
        *BLOCK,
        F.col("_blk_first_t").alias("first_t"),
        F.col("t_us").alias("last_t"),
        "_head",
        "_f",
        "_b",
        "_start",
        ((F.col("_sub") > 0) | opens_early | closes_late).alias("_near"),
    )
    # The blocks of a dense time block follow each other at once, so its first one stays as well.
    several = ends.where("_sub > 0").select(*FLOW_KEY, "_blk").distinct()
    if several.isEmpty():
        ends = ends.where("_near")
    else:
        dense = materialize(several.withColumn("_dense", F.lit(True)), "dense-flows")
        ends = meet(ends, dense, [*FLOW_KEY, "_blk"], "left").where("_near or _dense").drop("_dense")
    chain = Window.partitionBy(*FLOW_KEY, "_chain").orderBy("_blk", "_sub")
    chain_so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (
        ends.withColumn("_joined", F.coalesce(F.col("first_t") - F.lag("last_t").over(by_flow) <= gap_us, F.lit(False)))
        .withColumn("_chain", F.sum((~(F.col("_joined") & F.col("_head"))).cast("int")).over(by_flow))
        .withColumns(
            {
                "_end_f": F.sum("_f").over(chain_so_far),
                "_end_b": F.sum("_b").over(chain_so_far),
                "_end_start": F.first("_start").over(chain_so_far),
            }
        )
        .withColumns(
            {
                "in_f": F.lag("_end_f").over(by_flow),
                "in_b": F.lag("_end_b").over(by_flow),
                "in_start": F.lag("_end_start").over(by_flow),
            }
        )
        .where("_joined")
        .select(*BLOCK, "in_f", "in_b", "in_start")
    )
    inherits = F.col("_head") & F.col("in_start").isNotNull()
    if open_sessions is not None:
        local = local.where(F.col("_frames").isNull())
    # A key part may be null; it still names one flow.
    joined = meet(local, materialize(carry, "flow-carry"), BLOCK, "left")
    return joined.select(
        *columns,
        F.when(inherits, F.col("in_start")).otherwise(F.col("_start")).alias("session_start_us"),
        (F.col("_f") + F.when(inherits, F.col("in_f")).otherwise(F.lit(0.0))).alias("total_frames"),
        (F.col("_b") + F.when(inherits, F.col("in_b")).otherwise(F.lit(0.0))).alias("total_bytes"),
    )


def state_features(rows: DataFrame) -> DataFrame:
    """Duration and ratios of rows with ``running_flows`` columns."""
    duration = F.greatest((F.col("t_us") - F.col("session_start_us")) / F.lit(1_000_000.0), F.lit(0.001))
    return with_ratios(rows.withColumns({"duration": duration, "total_bytes": F.greatest("total_bytes", F.lit(0.0))}))


def running_flow_features(packets: DataFrame, **options) -> DataFrame:
    """Running features at every packet: totals since the session began, duration and ratios."""
    return state_features(running_flows(packets, **options))


def is_record() -> Column:
    """Whether an event with COUNTERS is a finished flow."""
    return (F.col("in_pkts") > 0) | (F.col("out_pkts") > 0)


def packet_fields(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "protocol_num": S.protocol_code(F.col("proto")),
            "flags_mask": S.tcp_flags_mask(F.col("flags")),
            "protocol": S.protocol_code(F.col("proto")).cast("double"),
        }
    )


def flow_features(events: DataFrame, **options) -> DataFrame:
    """Full feature rows: flow records use their own counters, packets the running flow state."""
    if not set(COUNTERS) <= set(events.columns):
        return packet_fields(running_flow_features(events, **options))
    running = running_flow_features(events.where(~is_record()), **options)
    records = flow_record_features(events.where(is_record()).drop(*BLOCK[-2:]))
    return packet_fields(running.unionByName(records.withColumn("session_start_us", F.lit(None).cast("long"))).drop(*COUNTERS))


def kept_flow_features(rows: DataFrame) -> DataFrame:
    """The same for rows that already have their ``running_flows`` columns, as a stream's state gives them."""
    if not set(COUNTERS) <= set(rows.columns):
        return packet_fields(state_features(rows))
    own = lambda record, running: F.when(is_record(), record).otherwise(running)
    running = F.greatest((F.col("t_us") - F.col("session_start_us")) / F.lit(1_000_000.0), F.lit(0.001))
    filled = rows.withColumns(
        {
            "duration": own(F.greatest(F.col("duration_ms") / 1000.0, F.lit(0.001)), running),
            "total_frames": own(F.greatest(F.col("in_pkts") + F.col("out_pkts"), F.lit(1.0)), F.col("total_frames")),
            "total_bytes": F.greatest(own(F.col("in_bytes") + F.col("out_bytes"), F.col("total_bytes")), F.lit(0.0)),
        }
    )
    return packet_fields(with_ratios(filled).drop(*COUNTERS))


def flow_summary(
    packets: DataFrame, gap_us: int = IDLE_GAP_US, block_us: int = BLOCK_US, most: int = BLOCK_ROWS
) -> DataFrame:
    """One row per flow session with its final totals and ratios.

    Packets become one row per stretch of a session within a block; only these rows meet by flow.
    """
    rows = cut_blocks(packets.select(*FLOW_KEY, "t_us", "event_id", "packet_size"), FLOW_KEY, block_us, most)
    in_block = Window.partitionBy(*BLOCK).orderBy("t_us", "event_id")
    cut = F.coalesce(F.col("t_us") - F.lag("t_us").over(in_block) > gap_us, F.lit(False)).cast("int")
    stretches = (
        rows.withColumn("_cut", cut)
        .withColumn("_local", F.sum("_cut").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*BLOCK, "_local")
        .agg(
            F.min("t_us").alias("first_t"),
            F.max("t_us").alias("last_t"),
            F.count(F.lit(1)).alias("_frames"),
            F.sum(F.col("packet_size").cast("double")).alias("_bytes"),
        )
    )
    by_flow = Window.partitionBy(*FLOW_KEY).orderBy("_blk", "_sub", "_local")
    joined = F.coalesce(F.col("first_t") - F.lag("last_t").over(by_flow) <= gap_us, F.lit(False))
    sessions = (
        stretches.withColumn("_new", (~joined).cast("int"))
        .withColumn("_session", F.sum("_new").over(by_flow.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*FLOW_KEY, "_session")
        .agg(
            F.min("first_t").alias("session_start_us"),
            F.max("last_t").alias("last_us"),
            F.sum("_frames").cast("double").alias("total_frames"),
            F.sum("_bytes").alias("total_bytes"),
        )
        .drop("_session")
    )
    duration = F.greatest((F.col("last_us") - F.col("session_start_us")) / F.lit(1_000_000.0), F.lit(0.001))
    return with_ratios(sessions.withColumn("duration", duration))
