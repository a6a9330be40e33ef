"""Scores, severities and display labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry.functions.scalars import strip

# Fixed value: longest stored justification.
JUSTIFICATION_CHARS = 500

# Ports and weights of the fallback score.
RISKY_PORTS = [21, 22, 23, 445, 3389]

# Severity cut points, highest first.
SEVERITY_STEPS = [(0.95, "CRITICAL"), (0.80, "HIGH"), (0.55, "MEDIUM")]
PRIORITY_STEPS = [(0.85, "HIGH"), (0.60, "MEDIUM")]

# Attack class by keyword, first class wins.
ATTACK_KEYWORDS = [
    ("DDoS / SYN Flood", ["syn", "flood", "ddos"]),
    ("Brute Force / Credential Attack", ["brute", "ssh", "telnet", "rdp"]),
    ("Port Scan / Reconnaissance", ["scan", "recon"]),
    ("Malware / C2 Communication", ["otx", "ioc", "malware", "c2"]),
]

ANOMALY_TYPE = "xgboost_anomaly"
SIGNATURE_SOURCES = ["snort", "suricata", "otx", "builtin"]


def heuristic_score(dst_port: Column, total_bytes: Column, flags_mask: Column, protocol: Column) -> Column:
    """Score used when no model is given; terms are added in this order so that 0.75 is reached exactly."""

    def part(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    score = part(dst_port.isin(RISKY_PORTS), 0.35)
    score = score + part(total_bytes > 1200, 0.2)
    score = score + part(flags_mask.isin(2, 18), 0.2)
    score = score + part(protocol == 0, 0.15)
    return F.least(score, F.lit(0.99))


def anomaly_label(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, F.lit(ANOMALY_TYPE)).otherwise(F.lit("benign"))


def _steps(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    out = F.lit(lowest)
    for bound, name in reversed(steps):
        out = F.when(score >= bound, F.lit(name)).otherwise(out)
    return out


def severity4(score: Column) -> Column:
    return _steps(score, SEVERITY_STEPS, "LOW")


def priority3(score: Column) -> Column:
    return _steps(score, PRIORITY_STEPS, "LOW")


def attack_class_hint(alert_type: Column) -> Column:
    """Suggested class for an alert type, empty text if no keyword fits."""
    text = F.lower(F.coalesce(alert_type, F.lit("")))
    out = F.lit("")
    for name, words in reversed(ATTACK_KEYWORDS):
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def clean_justification(text: Column, longest: int | None = JUSTIFICATION_CHARS) -> Column:
    """Trim, cut to ``longest`` characters (None: keep all), then drop tags."""
    kept = strip(F.coalesce(text, F.lit("")))
    return F.regexp_replace(kept if longest is None else F.substring(kept, 1, longest), r"<[^>]+>", "")


def justification_text(preset: Column, notes: Column, decision: Column) -> Column:
    """Text stored with a decision: preset and notes, or a standard sentence."""
    chosen = F.when(preset != "other", F.nullif(preset, F.lit("")))
    joined = F.concat_ws(" — ", chosen, F.nullif(strip(notes), F.lit("")))
    fallback = F.when(decision == "ignored", F.lit("No justification provided")).otherwise(F.lit("Confirmed threat"))
    return clean_justification(F.coalesce(F.nullif(joined, F.lit("")), fallback))


def chart_label(alert_type: Column) -> Column:
    """Type without the first ``signature:``, at most 28 characters."""
    at = F.locate("signature:", alert_type)
    without = F.when(
        at > 0, F.concat(alert_type.substr(F.lit(1), at - 1), alert_type.substr(at + 10, F.length(alert_type)))
    ).otherwise(alert_type)
    return F.substring(without, 1, 28)


def policy_action(mode: str, is_signature: Column) -> Column:
    """Action by response mode: detect-only, block-signature or soc-queue-ml."""
    signature = "blocked" if mode == "block-signature" else "detect"
    model = "queued_soc" if mode == "soc-queue-ml" else "detect"
    return F.when(is_signature, F.lit(signature)).otherwise(F.lit(model))


def escalated_score(signature_score: Column, model_score: Column) -> Column:
    return F.round(F.least((signature_score + model_score) / 2 + F.lit(0.05), F.lit(0.99)), 4)
