"""Rule text parsing and first-match rule lookup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.schemas import RULE_COLUMNS
from flowsentry.session import BROADCAST_BYTES, BROADCAST_ROW_LIMIT, materialize

# Accepted rule header and option forms.
HEADER_PATTERN = (
    r"^(alert|drop|reject|pass)\s+(\w+)\s+(\S+)\s+(\S+)\s+->\s+(\S+)\s+(\S+)\s*\((.*)\)\s*$"
)
MSG_PATTERN = r'msg\s*:\s*"?([^;"]+)"?'
SID_PATTERN = r'sid\s*:\s*"?([^;"]+)"?'
DEFAULT_NAME = "SnortRule"

# Rules that are always present (name, src_ip, dst_port, proto, severity).
BUILTIN_RULES = [
    ("KnownMaliciousSSH", "10.10.10.66", 22, None, 0.95),
    ("TelnetBruteforcePattern", None, 23, "TCP", 0.95),
    ("HighRiskRDP", None, 3389, "TCP", 0.85),
]

MATCH_FIELDS = ["src_ip", "dst_ip", "dst_port", "proto"]
ORDER_TYPE = "struct<tier:int,path:string,split:bigint,line:bigint>"


def rule_order(tier: int, path: Column | None = None, split: Column | None = None, line: Column | None = None) -> Column:
    """Sort key of a rule: list, then file, then position in the file."""
    return F.struct(
        F.lit(tier).alias("tier"),
        (path if path is not None else F.lit("")).alias("path"),
        (split if split is not None else F.lit(0)).cast("long").alias("split"),
        (line if line is not None else F.lit(0)).cast("long").alias("line"),
    )


def builtin_rules(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("line"),
            F.lit(name).alias("name"),
            F.lit(src_ip).cast("string").alias("src_ip"),
            F.lit(dst_port).cast("int").alias("dst_port"),
            F.lit(proto).cast("string").alias("proto"),
            F.lit(severity).alias("severity"),
        )
        for i, (name, src_ip, dst_port, proto, severity) in enumerate(BUILTIN_RULES)
    ]
    return spark.range(1).select(F.inline(F.array(*rows))).select(
        rule_order(0, line=F.col("line")).alias("ord"),
        "name",
        F.lit(None).cast("string").alias("sid"),
        "src_ip",
        F.lit(None).cast("string").alias("dst_ip"),
        "dst_port",
        "proto",
        "severity",
        F.lit("builtin").alias("source_engine"),
    )


def ip_token(token: Column, strict: bool = False) -> Column:
    """Address of a rule, null for ``any`` and for forms that name no single address."""
    open_form = (F.lower(token) == "any") | token.rlike(r"[$\[,/!]")
    return F.when(~open_form, token)


def port_token(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int"))


def rule_severity(engine: str) -> Column:
    """Both dialects end at the same severity; the second one only guarantees a lower floor."""
    return F.greatest(F.lit(0.98), F.lit(0.97)) if engine == "suricata" else F.lit(0.98)


def parse_rules(lines: DataFrame, engine: str = "snort", skip_unrepresentable: bool = False) -> DataFrame:
    """Rules from (ord, line). Lines without a valid header are dropped.

    Variables, lists, ranges and negations become wildcards; with ``skip_unrepresentable`` such rules are left out.
    """
    text = F.trim(F.regexp_replace(F.col("line"), r"^\s+|\s+$", ""))
    part = lambda i: F.regexp_extract("text", HEADER_PATTERN, i)
    option = lambda pattern: F.nullif(F.trim(F.regexp_extract("options", pattern, 1)), F.lit(""))
    parsed = (
        lines.select("ord", text.alias("text"))
        .where((F.col("text") != "") & ~F.col("text").startswith("#") & F.col("text").rlike(HEADER_PATTERN))
        .select(
            "ord",
            part(2).alias("header_proto"),
            part(3).alias("src"),
            part(5).alias("dst"),
            part(6).alias("port"),
            part(7).alias("options"),
        )
    )
    if skip_unrepresentable:
        single = lambda c: (F.lower(c) == "any") | ip_token(c).isNotNull()
        parsed = parsed.where(
            single(F.col("src"))
            & single(F.col("dst"))
            & ((F.lower("port") == "any") | port_token(F.col("port")).isNotNull())
        )
    return parsed.select(
        "ord",
        F.coalesce(option(MSG_PATTERN), F.lit(DEFAULT_NAME)).alias("name"),
        option(SID_PATTERN).alias("sid"),
        ip_token(F.col("src")).alias("src_ip"),
        ip_token(F.col("dst")).alias("dst_ip"),
        port_token(F.col("port")).alias("dst_port"),
        F.when(F.lower("header_proto") != "ip", F.upper("header_proto")).alias("proto"),
        rule_severity(engine).alias("severity"),
        F.lit(engine).alias("source_engine"),
    )


def rule_union(*lists: DataFrame) -> DataFrame:
    """All rules with one total order; each list brings its own tier in ``ord``."""
    return reduce(lambda a, b: a.unionByName(b), [r.select(*RULE_COLUMNS) for r in lists])


@dataclass(frozen=True)
class RuleTable:
    """The first rule for each set of field values, written once, and whether each group of fixed fields was measured to
    be small in rows and bytes."""

    firsts: DataFrame
    groups: dict[int, bool]


def rule_table(rules: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> RuleTable:
    """Null and 0/empty rule fields are wildcards; rules are grouped by the set of fields they fix (at most 16 groups)."""
    fixed = {
        "src_ip": F.coalesce("src_ip", F.lit("")) != "",
        "dst_ip": F.coalesce("dst_ip", F.lit("")) != "",
        "dst_port": F.coalesce("dst_port", F.lit(0)) != 0,
        "proto": F.coalesce("proto", F.lit("")) != "",
    }
    mask = reduce(lambda a, b: a + b, [F.when(fixed[f], 1 << i).otherwise(0) for i, f in enumerate(MATCH_FIELDS)])
    body = F.struct("ord", "name", "severity", "sid", "source_engine")
    firsts = (
        rules.withColumns({"_mask": mask, **{f: F.when(fixed[f], F.col(f)) for f in MATCH_FIELDS}})
        .groupBy("_mask", *MATCH_FIELDS)
        .agg(F.min(body).alias("_rule"))
    )
    # Rule text is parsed once, not once per group.
    firsts = materialize(firsts, "rules")
    texts = [F.col(c) for c in ("src_ip", "dst_ip", "proto")] + [F.col(f"_rule.{c}") for c in ("name", "sid", "source_engine")]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(t), F.lit(0)) for t in texts], F.lit(200))
    # One row per field combination, never more than 16.
    sums = firsts.groupBy("_mask").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    # All groups may be replicated at once, so they share the bound.
    most = BROADCAST_BYTES // max(1, len(sums))
    return RuleTable(firsts, {r["_mask"]: r["n"] <= limit and r["bytes"] <= most for r in sums})


def first_rule_match(rows: DataFrame, rules: DataFrame | RuleTable, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Add ``rule`` = struct(ord, name, severity, sid, source_engine) of the first rule a row satisfies, or null.

    Each group of a ``rule_table`` holds the first rule per field values, so it is one equality join that cannot
    multiply rows. A group is replicated only if it was counted to be small.
    """
    table = rules if isinstance(rules, RuleTable) else rule_table(rules, limit)
    out, found = rows, []
    for number, small in sorted(table.groups.items()):
        keys = [f for i, f in enumerate(MATCH_FIELDS) if number >> i & 1]
        group = table.firsts.where(F.col("_mask") == number)
        if not keys:
            # Only one rule can be first without any condition; it is a scalar, not a join.
            found.append(group.select("_rule").scalar())
            continue
        name = f"_rule{number}"
        found.append(F.col(name))
        group = group.select(*keys, F.col("_rule").alias(name))
        out = out.join(F.broadcast(group) if small else group, keys, "left")
    if not found:
        return rows.withColumn("rule", F.lit(None).cast(table.firsts.schema["_rule"].dataType))
    first = found[0] if len(found) == 1 else F.least(*found)
    return out.withColumn("rule", first).select(*rows.columns, "rule")
