"""Indicator sets, indicator matching and threat-feed views."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions import scalars as S
from flowsentry.session import fits_broadcast, materialize

IOC_NAME = "ThreatIntel_IPv4_IOC"
IOC_SEVERITY = 0.99


def indicators_in_text(texts: DataFrame, column: str) -> DataFrame:
    """Distinct valid IPv4 addresses found anywhere in a text column."""
    # Ids repeat a lot within a text and between copies; array_distinct and the partial aggregate thin them early.
    found = texts.select(F.explode(F.array_distinct(S.extract_ipv4(F.col(column)))).alias("ip"))
    return found.where(S.valid_ipv4(F.col("ip"))).distinct()


def indicator_union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select("ip") for s in sets]).distinct()


@dataclass(frozen=True)
class IndicatorSet:
    """Distinct indicators, written once, and whether they were counted to be small."""

    ips: DataFrame
    small: bool


def indicator_set(indicators: DataFrame) -> IndicatorSet:
    ips = materialize(indicators.select("ip").distinct(), "indicators")
    return IndicatorSet(ips, fits_broadcast(ips))


def ioc_match(rows: DataFrame, indicators: DataFrame | IndicatorSet, small: bool | None = None) -> DataFrame:
    """Add ``ioc``: source or destination address is an indicator.

    Two equality joins, never one OR condition. The indicator side is replicated only when it was counted
    to be small; otherwise both joins shuffle by address and adaptive execution splits hot addresses. A job that matches
    more than once prepares an ``indicator_set``.
    """
    known = indicators if isinstance(indicators, IndicatorSet) else indicator_set(indicators)
    side = F.broadcast if (known.small if small is None else small) else (lambda df: df)
    out = rows
    for address in ("src_ip", "dst_ip"):
        hits = known.ips.select(F.col("ip").alias(address), F.lit(True).alias(f"_{address}_hit"))
        out = out.join(side(hits), address, "left")
    hit = F.coalesce("_src_ip_hit", "_dst_ip_hit", F.lit(False))
    return out.select(*rows.columns, hit.alias("ioc"))


def feed_search(entries: DataFrame, query: str, *columns: str) -> DataFrame:
    """Entries where any of the columns contains the (lower-case) query; empty query keeps all."""
    text = query.strip().lower()
    if not text:
        return entries
    return entries.where(_any_contains(text, columns))


def _any_contains(text: str, columns: tuple[str, ...]) -> Column:
    tests = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text)) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def search_abuse(entries: DataFrame, query: str) -> DataFrame:
    return feed_search(entries, query, "ip", "isp", "country")


def search_c2(entries: DataFrame, query: str, with_country: bool = False) -> DataFrame:
    """The stored list matches address and family; the table view also matches the country."""
    return feed_search(entries, query, "ip", "malware", *(["country"] if with_country else []))


def search_blocked(entries: DataFrame, query: str) -> DataFrame:
    return feed_search(entries, query, "src_ip", "reason")


def feed_counts(**feeds: DataFrame) -> DataFrame:
    """Entries per feed or list, counted before any display cap."""
    counts = [df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(n).alias("feed"), "entries") for n, df in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def listed(entries: DataFrame, order: list[Column], cap: int | None = None) -> DataFrame:
    """Entries in display order; ``cap`` cuts the list for a display that wants no more."""
    rows = entries.orderBy(*order)
    return rows if cap is None else rows.limit(cap)
