"""Sliding-window thresholds: SYN floods and login brute force.

"At least n events of a key in the trailing w seconds" is tested with ``lag(t, n - 1)`` in arrival order
(time, event id). Windows run per (key, block); blocks are cut by time and, where rows are dense, by count, and
every block also gets the times of the n - 1 rows before it. So a key that owns a large part of the stream is spread
over as many tasks as it has blocks, even where all its rows lie within a second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry.functions import scalars as S
from flowsentry.operators.cooldown import keep_after_cooldown
from flowsentry.operators.dense import BLOCK_ROWS, cut_blocks, same
from flowsentry.session import materialize

SECOND = 1_000_000
#: Default block length in windows.
BLOCK_WINDOWS = 8


@dataclass(frozen=True)
class SynFlood:
    """SYN flood rule."""

    count: int = 30
    window_us: int = 3 * SECOND
    cooldown_us: int = 10 * SECOND
    severity: float = 0.96
    name: str = "SYNFloodIndicator"


@dataclass(frozen=True)
class LoginService:
    port: int
    service: str
    attempts: int
    window_s: int
    cooldown_s: int


# Watched login services.
LOGIN_SERVICES = [
    LoginService(21, "FTP", 10, 30, 60),
    LoginService(22, "SSH", 6, 30, 60),
    LoginService(23, "Telnet", 8, 30, 60),
    LoginService(25, "SMTP", 10, 60, 120),
    LoginService(110, "POP3", 8, 30, 60),
    LoginService(143, "IMAP", 8, 30, 60),
    LoginService(3389, "RDP", 5, 30, 120),
    LoginService(5900, "VNC", 5, 30, 120),
    LoginService(445, "SMB", 8, 30, 120),
]
#: Severity grows by 0.01 per attempt over the limit and stops at 0.99, so four extra attempts decide it.
SEVERITY_EXTRA = 4


def service_table(spark: SparkSession, services: list[LoginService] = LOGIN_SERVICES) -> DataFrame:
    rows = [
        F.struct(
            F.lit(s.port).alias("dst_port"),
            F.lit(s.service).alias("service"),
            F.lit(s.attempts).alias("attempts"),
            F.lit(s.window_s * SECOND).cast("long").alias("window_us"),
            F.lit(s.cooldown_s * SECOND).cast("long").alias("cooldown_us"),
        )
        for s in services
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def service_lookup(rows: DataFrame, services: list[LoginService] = LOGIN_SERVICES) -> DataFrame:
    """Keep rows whose destination port is a watched service and add its policy columns."""
    # The policy is a constant list in this module, so its size does not depend on the data.
    return rows.join(F.broadcast(service_table(rows.sparkSession, services)), "dst_port")


def syn_only(rows: DataFrame) -> DataFrame:
    return rows.where(S.syn_only(F.col("proto"), F.col("flags")))


def trailing_hits(
    rows: DataFrame,
    keys: list[str],
    need: Column,
    within_us: Column,
    needs: list[int],
    longest_us: int,
    extra: int = 0,
    block_us: int | None = None,
    most: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows that complete a trailing window, with ``over`` = rows beyond the limit (at most ``extra``).

    ``need`` rows within ``within_us`` (both inclusive, current row counted) make a hit; ``needs`` lists the
    values ``need`` can take. A block gets the times of the ``max(needs) - 1 + extra`` rows before it, however long
    ago these were and from however many blocks they come, and no other row of its neighbours.
    """
    by = [*keys, "_blk", "_sub"]
    # Few and narrow, and read three times: to count blocks, for their last rows, and for the windows.
    rows = materialize(rows, "watched-rows")
    cut = cut_blocks(rows, keys, max(block_us or BLOCK_WINDOWS * longest_us, longest_us), most)
    arrival = Window.partitionBy(*by).orderBy("t_us", "event_id")
    offsets = sorted({n - 1 + j for n in needs for j in range(extra + 1)})
    reach = offsets[-1]

    # The last rows of each block, and before each block those of the blocks before it. Every block has a row, so
    # ``reach`` blocks hold enough of them.
    last = cut.select(*by, "t_us", "event_id").withColumn("_later", F.lead("t_us", reach).over(arrival)).where("_later is null")
    tails = last.groupBy(*by).agg(F.sort_array(F.collect_list("t_us")).alias("_tail"))
    blocks = Window.partitionBy(*keys).orderBy("_blk", "_sub").rowsBetween(-reach, -1)
    before = F.flatten(F.collect_list("_tail").over(blocks))
    halo = tails.select(*by, F.slice(before, F.greatest(F.size(before) - reach + 1, F.lit(1)), reach).alias("_before"))

    named = halo.withColumnsRenamed({k: f"{k}_halo" for k in by})
    numbered = (
        cut.withColumns({"_need": need, "_within": within_us, "_row": F.row_number().over(arrival)})
        .withColumns({f"_lag{o}": F.lag("t_us", o).over(arrival) for o in offsets})
        .join(named, same(by, "_halo"), "left")
    )

    def back(o: int) -> Column:
        """Time of the row that came ``o`` rows earlier, in this block or before it."""
        # Outside of the array, so also for a row that has as many before it in its block, ``get`` gives null.
        return F.coalesce(f"_lag{o}", F.get("_before", F.size("_before") + F.col("_row") - F.lit(o + 1)))

    def near(o: int) -> Column:
        return F.coalesce(F.col("t_us") - F.col(f"_back{o}") <= F.col("_within"), F.lit(False))

    def by_need(value, none: Column) -> Column:
        for n in sorted(set(needs)):
            none = F.when(F.col("_need") == n, value(n)).otherwise(none)
        return none

    # A filter is computed apart from the columns, each time is one column, and rows come in order of time, so the
    # nearest time alone makes a hit: all in one expression was a method too long to be compiled at run time.
    timed = numbered.withColumns({f"_back{o}": back(o) for o in offsets})
    hits = timed.where(by_need(lambda n: near(n - 1), F.lit(False)))
    over = by_need(lambda n: sum((near(n - 1 + j).cast("int") for j in range(1, extra + 1)), F.lit(0)), F.lit(0))
    return hits.select(*rows.columns, over.alias("over"))


def syn_flood_candidates(syn_rows: DataFrame, rule: SynFlood = SynFlood(), **options) -> DataFrame:
    return trailing_hits(
        syn_rows, ["src_ip"], F.lit(rule.count), F.lit(rule.window_us), [rule.count], rule.window_us, **options
    )


def syn_flood(
    syn_rows: DataFrame, rule: SynFlood = SynFlood(), last_alerts: DataFrame | None = None, **options
) -> DataFrame:
    """SYN flood alerts (src_ip, t_us, event_id, name, severity) after the cooldown."""
    candidates = syn_flood_candidates(syn_rows.select("src_ip", "t_us", "event_id"), rule, **options).drop("over")
    kept = keep_after_cooldown(candidates, ["src_ip"], F.lit(rule.cooldown_us), last_alerts=last_alerts)
    return kept.withColumns({"name": F.lit(rule.name), "severity": F.lit(rule.severity)})


def login_candidates(login_rows: DataFrame, services: list[LoginService] = LOGIN_SERVICES, **options) -> DataFrame:
    """Connection attempts that complete a service's window; input is ``service_lookup`` output."""
    return trailing_hits(
        login_rows,
        ["src_ip", "dst_port"],
        F.col("attempts"),
        F.col("window_us"),
        [s.attempts for s in services],
        max(s.window_s for s in services) * SECOND,
        extra=SEVERITY_EXTRA,
        **options,
    )


def login_bruteforce(
    syn_rows: DataFrame,
    services: list[LoginService] = LOGIN_SERVICES,
    last_alerts: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Login brute-force alerts (src_ip, dst_port, t_us, event_id, name, severity) after the cooldown."""
    columns = ["src_ip", "dst_port", "t_us", "event_id"]
    watched = service_lookup(syn_rows.select(*columns), services)
    candidates = login_candidates(watched, services, **options).select(
        *columns,
        "cooldown_us",
        F.concat(F.lit("L7BruteForce_"), F.col("service")).alias("name"),
        F.least(F.lit(0.95) + F.lit(0.01) * F.col("over"), F.lit(0.99)).alias("severity"),
    )
    kept = keep_after_cooldown(candidates, ["src_ip", "dst_port"], F.col("cooldown_us"), last_alerts=last_alerts)
    return kept.drop("cooldown_us")
