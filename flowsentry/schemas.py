"""Record layouts shared by readers, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

# Order of the model vector.
MODEL_FEATURES = [
    "total_frames",
    "total_bytes",
    "duration",
    "avg_pkt_size",
    "pkts_per_sec",
    "bytes_per_sec",
    "protocol",
]

# Flow training columns.
FLOW_CSV_COLUMNS = [
    "PROTOCOL",
    "IN_BYTES",
    "IN_PKTS",
    "OUT_BYTES",
    "OUT_PKTS",
    "FLOW_DURATION_MILLISECONDS",
    "Label",
]

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

MODEL_STRUCT = _struct(**{name: _D for name in MODEL_FEATURES})

#: Events as they arrive; both spellings of the address keys are accepted.
EVENT_JSON = _struct(
    event_id=_L,
    ts=T.TimestampType(),
    timestamp=_S,
    src_ip=_S,
    src=_S,
    dest_ip=_S,
    dest=_S,
    src_port=_I,
    dest_port=_I,
    proto=_S,
    bytes=_L,
    tcp_flags=_S,
    IN_PKTS=_D,
    OUT_PKTS=_D,
    IN_BYTES=_D,
    OUT_BYTES=_D,
    FLOW_DURATION_MILLISECONDS=_D,
)

# Field names of stored alerts.
ALERT_JSON = _struct(
    id=_S,
    timestamp=_S,
    src_ip=_S,
    dst_ip=_S,
    src_port=_I,
    dst_port=_I,
    protocol=_S,
    type=_S,
    score=_D,
    action=_S,
    source=_S,
    model_features=MODEL_STRUCT,
    status=_S,
    sid=_S,
    ml_score=_D,
    hybrid_confirmed=_B,
    ignore_justification=_S,
    resolve_justification=_S,
)

#: Feature values stay strings so that a missing key, a null and bad text can be told apart.
FEEDBACK_JSON = _struct(
    event=_S,
    decision_timestamp=_S,
    decision=_S,
    alert_id=_S,
    alert=_struct(id=_S, timestamp=_S, type=_S, src_ip=_S, model_features=T.MapType(_S, _S)),
    justification=_S,
)

DECISION = _struct(id=_S, new_status=_S, justification=_S, decision_ts=T.TimestampType())

BLOCK_LOG = _struct(timestamp=_S, src_ip=_S, reason=_S, mode=_S)

RULE_COLUMNS = ["ord", "name", "sid", "src_ip", "dst_ip", "dst_port", "proto", "severity", "source_engine"]

PULSE_PAGE = _struct(
    results=T.ArrayType(_struct(indicators=T.ArrayType(_struct(type=_S, indicator=_S)))),
)

# Field names of the two address feeds.
ABUSE_FEED = _struct(
    data=T.ArrayType(
        _struct(
            ipAddress=_S,
            abuseConfidenceScore=_I,
            countryCode=_S,
            isp=_S,
            lastReportedAt=_S,
            totalReports=_I,
        )
    )
)

C2_FEED = _struct(
    ip_address=_S,
    malware=_S,
    status=_S,
    country=_S,
    first_seen=_S,
    last_online=_S,
    port=_S,
)

# Field names of training runs.
RUN = _struct(
    run_id=_S,
    timestamp=_S,
    sampled_rows=_L,
    attack_ratio=_D,
    feedback_rows_used=_L,
    val_f1=_D,
    val_precision=_D,
    val_recall=_D,
    recommended_threshold=_D,
    best_iteration=_I,
    best_score=_D,
    archived_model=_S,
    promoted=_B,
    kind=_S,
    report_f1=_D,
)
