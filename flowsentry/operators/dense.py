"""Cutting rows of a key into blocks by time and, where they are dense, by count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import fits_broadcast, materialize

#: Rows of a time block from which it is cut further.
BLOCK_ROWS = 250_000
#: Cuts are found from quantiles that are right to within this share of a cut's rows.
EXACTNESS = 10


def cut_blocks(rows: DataFrame, keys: list[str], block_us: int, most: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` (number of the time block) and ``_sub``: together they number blocks of at most about ``most`` rows.

    Blocks of a key follow each other in the order of (t_us, event_id), by _blk, then _sub. A time block with more rows
    is cut at quantiles of its rows' order, so a million rows of one key within a second, or even at one time, are many
    blocks. Rows are counted by (key, time block), combined before the shuffle; the quantiles are summaries of bounded
    size that are merged likewise. The order is time plus the event id's place between the least and the largest id of
    the block, as one number.
    """
    blocked = rows.withColumn("_blk", F.floor(F.col("t_us") / block_us))
    by = [*keys, "_blk"]
    dense = (
        blocked.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("event_id").alias("_low"), F.max("event_id").alias("_high"))
        .where(F.col("_n") > most)
    )
    largest = dense.agg(F.max("_n")).first()[0]
    if largest is None:
        return blocked.withColumn("_sub", F.lit(0))
    dense = materialize(dense, "dense-blocks")
    parts = -(-largest // most)
    share = (F.col("event_id").cast("double") - F.col("_low").cast("double")) / (
        F.col("_high").cast("double") - F.col("_low").cast("double") + 1.0
    )
    order = (F.col("t_us") - F.col("_blk") * block_us).cast("double") + F.coalesce(share, F.lit(0.0))
    steps = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = (
        meet(blocked.select(*by, "t_us", "event_id"), dense, by, "inner")
        .groupBy(*by, "_low", "_high")
        .agg(F.percentile_approx(order, steps, F.lit(EXACTNESS * parts)).alias("_cuts"))
    )
    cuts = materialize(cuts, "dense-cuts")
    before = F.size(F.filter("_cuts", lambda c: c < order))
    return meet(blocked, cuts, by, "left").withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(before)).drop("_low", "_high", "_cuts")


def same(keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys])


def meet(rows: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; ``side`` has one row for each and is replicated if it was measured to be small."""
    named = side.withColumnsRenamed({k: f"{k}_side" for k in keys})
    named = F.broadcast(named) if fits_broadcast(named) else named
    return rows.join(named, same(keys, "_side"), how).drop(*[f"{k}_side" for k in keys])
