"""Analyst decisions: validation, status changes and feedback rows.

Alerts are never rewritten. Decisions are appended to their own table; the current state of an alert is the
stored alert joined with its decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import scalars as S
from flowsentry.operators.alerts import status_of

STATUSES = ["ignored", "resolved", "pending"]


def _requested(requests: DataFrame, max_ids: int | None) -> tuple[DataFrame, list[str]]:
    """One row per id asked for, with ``refusal`` (null for a valid one)."""
    other = [c for c in requests.columns if c not in ("ids", "new_status", "justification")]
    rows = requests.select(
        *other,
        F.posexplode("ids").alias("_place", "id"),
        F.lower(S.strip(F.coalesce("new_status", F.lit("pending")))).alias("new_status"),
        L.clean_justification(F.col("justification")).alias("justification"),
    ).withColumn("id", S.strip(F.col("id")))
    refusal = F.when(~F.col("new_status").isin(STATUSES), F.lit("status"))
    if max_ids is not None:
        refusal = refusal.when(F.col("_place") >= max_ids, F.lit("too many ids"))
    refusal = refusal.when(~F.coalesce(F.col("id").rlike(S.UUID_PATTERN), F.lit(False)), F.lit("no alert id"))
    return rows.withColumn("refusal", refusal), other


def validate_decisions(requests: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Rows (ids, new_status, justification, ...) → one row per valid alert id.

    Ids that are no UUIDs and requests with another status are refused, see ``refused_decisions``; so are, if
    ``max_ids`` is given, the ids of a request beyond that number. Text is trimmed, cut and stripped of tags.
    """
    rows, other = _requested(requests, max_ids)
    kept = rows.where(F.col("refusal").isNull()).select(*other, "id", "new_status", "justification")
    return kept.dropDuplicates([*other, "id", "new_status", "justification"])


def refused_decisions(requests: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Every id ``validate_decisions`` leaves out, with the reason."""
    rows, other = _requested(requests, max_ids)
    return rows.where(F.col("refusal").isNotNull()).select(*other, "id", "new_status", "refusal")


def effective_decisions(decisions: DataFrame) -> DataFrame:
    """Per alert: the first decision that closes it, and the texts written up to then.

    ``decisions`` has id, new_status, justification and decision_ts. A ``pending`` decision leaves the alert
    open but still writes its text as a resolve justification.
    """
    closing = F.col("new_status") != "pending"
    order = F.struct("decision_ts", "new_status", "justification")
    closed = decisions.where(closing).groupBy("id").agg(F.min(order).alias("_closed"))
    # Whatever comes after the closing decision finds the alert no longer pending.
    counted = decisions.withColumn("_order", order).join(closed, "id", "left").where(
        F.col("_closed").isNull() | (F.col("_order") <= F.col("_closed"))
    )
    has_text = F.coalesce("justification", F.lit("")) != ""
    to_resolve = has_text & (F.col("new_status") != "ignored")
    return counted.groupBy("id").agg(
        F.coalesce(F.max("_closed.new_status"), F.lit("pending")).alias("new_status"),
        F.max("decision_ts").alias("decision_ts"),
        F.max_by(F.when(closing & has_text, F.col("justification")), F.col("_order")).alias("justification"),
        F.max(F.when(has_text & (F.col("new_status") == "ignored"), F.col("justification"))).alias("ignore_text"),
        F.max_by(
            F.when(to_resolve, F.col("justification")), F.when(to_resolve, F.col("_order"))
        ).alias("resolve_text"),
    )


def apply_decisions(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current alerts with ``changed``, ``decision_ts`` and ``justification`` of the decision that changed them."""
    found = effective_decisions(decisions)
    joined = alerts.join(found, "id", "left")
    changed = F.col("new_status").isNotNull() & (status_of(alerts) == "pending")
    pick = lambda new, old: F.when(changed, F.coalesce(F.col(new), F.col(old))).otherwise(F.col(old)).alias(old)
    replaced = {
        "status": F.when(changed, F.col("new_status")).otherwise(status_of(alerts)).alias("status"),
        "ignore_justification": pick("ignore_text", "ignore_justification"),
        "resolve_justification": pick("resolve_text", "resolve_justification"),
    }
    return joined.select(
        *[replaced.get(c, F.col(c)) for c in alerts.columns],
        changed.alias("changed"),
        F.when(changed, F.col("decision_ts")).alias("decision_ts"),
        F.when(changed, F.col("justification")).alias("justification"),
    )


def alert_record(alerts: DataFrame) -> list[Column]:
    """Alert columns in the stored JSON layout."""
    return [
        F.col("id"),
        S.iso_text(F.col("ts")).alias("timestamp"),
        *[
            F.col(c)
            for c in (
                "src_ip dst_ip src_port dst_port protocol type score action source model_features status sid ml_score "
                "hybrid_confirmed ignore_justification resolve_justification"
            ).split()
        ],
    ]


def feedback_rows(decided: DataFrame) -> DataFrame:
    """One feedback row per alert that was ignored or resolved."""
    closed = decided.where(F.col("changed") & F.col("status").isin("ignored", "resolved"))
    return closed.select(
        F.lit("analyst_feedback").alias("event"),
        S.iso_text(F.col("decision_ts")).alias("decision_timestamp"),
        F.col("status").alias("decision"),
        F.col("id").alias("alert_id"),
        F.struct(*alert_record(closed)).alias("alert"),
        F.nullif("justification", F.lit("")).alias("justification"),
    )
