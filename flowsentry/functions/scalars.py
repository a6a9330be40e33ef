"""Scalar helpers used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry.schemas import MODEL_FEATURES

# What counts as an address and as an alert id. Word boundaries are those of Unicode text, so "é1.2.3.4"
# holds no address.
IPV4_PATTERN = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Bit of every TCP flag letter.
FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "E": 64, "C": 128}

# Protocol codes of the model vector.
PROTOCOL_CODES = {"ICMP": 1, "TCP": 6, "UDP": 17}


def extract_ipv4(text: Column) -> Column:
    """Array of all dotted quads in ``text`` (not yet range-checked)."""
    return F.regexp_extract_all(text, F.lit(IPV4_PATTERN), F.lit(0))


def valid_ipv4(ip: Column) -> Column:
    """Four numeric parts, each at most 255; leading zeros are fine."""
    parts = F.split(ip, r"\.", -1)
    in_range = F.forall(
        parts, lambda p: p.rlike("^[0-9]+$") & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(256)) <= 255)
    )
    return F.coalesce((F.size(parts) == 4) & in_range, F.lit(False))


def minute_floor(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return x


def round4(x: Column) -> Column:
    return F.round(x, 4)


def safe_double(x: Column, default: float | None = None) -> Column:
    """Cast that yields ``default`` (or null) for text that is no number; with a default, NaN is no number either."""
    value = x.try_cast("double")
    return value if default is None else F.coalesce(F.nanvl(value, F.lit(default)), F.lit(default))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def text_or(x: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def parse_iso(text: Column, as_of: Column | None = None) -> Column:
    """ISO time, ``Z`` accepted; bad or empty text becomes ``as_of`` (null if none is given)."""
    parsed = F.try_to_timestamp(F.nullif(strip(text), F.lit("")))
    return parsed if as_of is None else F.coalesce(parsed, as_of)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(3_600_000_000)


def protocol_code(proto: Column) -> Column:
    code = F.lit(0)
    for name, number in PROTOCOL_CODES.items():
        code = F.when(proto == name, F.lit(number)).otherwise(code)
    return code.cast("int")


def tcp_flags_mask(flags: Column) -> Column:
    bits = [F.when(F.contains(flags, F.lit(letter)), F.lit(bit)).otherwise(F.lit(0)) for letter, bit in FLAG_BITS.items()]
    return F.coalesce(reduce(lambda a, b: a + b, bits), F.lit(0))


def syn_only(proto: Column, flags: Column) -> Column:
    """TCP connection attempts that are not answers."""
    return (proto == "TCP") & F.contains(flags, F.lit("S")) & ~F.contains(flags, F.lit("A"))


def private_ip(ip: Column) -> Column:
    """Addresses that begin with 10., 192.168. or 172.16. to 172.31."""
    text = F.coalesce(ip, F.lit(""))
    first, second = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    more, third = F.size(F.split(text, r"\.", -1)) > 1, F.size(F.split(text, r"\.", -1)) > 2
    middle = second.isin([str(n) for n in range(16, 32)])
    return ((first == "10") & more) | ((first == "192") & (second == "168") & third) | ((first == "172") & middle & third)


def key_uuid(*parts: Column) -> Column:
    """UUID-shaped digest of an event key: the same event always gets the same id."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, length) for start, length in cuts])


def model_struct() -> Column:
    return F.struct(*[F.col(name).cast("double").alias(name) for name in MODEL_FEATURES])
