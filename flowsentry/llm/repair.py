"""Repair of conversation structure: faults, and the cheapest edits that bring the roles into order.

All rows are dealt out by ranges of (conv_id, turn, place in the table), so that a conversation of any length lies in
neighbouring partitions in its order, and are cut into blocks of at most BLOCK rows there. A block that is a whole
conversation is searched once. The blocks of a longer one are searched for each state before and behind them; these small
tables are combined by 64 neighbours at a time, level by level, and the way that was chosen at the top is handed down
again. So no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common, editsearch
from flowsentry.session import materialize

#: Rows of a block; two to the power of FAN_BITS neighbouring nodes are combined at a time.
BLOCK, FAN_BITS = 64, 6

#: What is known of a stretch of rows: counts, then what its neighbours have to know.
STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "least_turn", "most_turn", "turns", "first_initial", "last_initial", "first_turn", "last_turn"]
EDIT = ["conv_id", "turn", "place", "k", "edit", "role", "text"]
#: One table for all that a block gives: 0 a whole conversation, 1 a block of a cut one, 2 an edit, 3 a row of a cut one.
WHOLE, PIECE, EDITED, RAW = range(4)
CUT = (
    "kind int, conv_id long, turn long, place long, k int, edit string, role string, text string, node long, stats array<long>, "
    "costs array<long>, ranks array<long>, audits array<string>, cost long, part long, at long"
)
NODE = "conv_id long, place long, pos long, stats array<long>, costs array<long>, ranks array<long>, children array<long>, states array<binary>"

TOP = "conv_id long, place long, stats array<long>, cost long, leaving int"
WAY = "node long, entry int, leaving int, last boolean"

_NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def faults(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the table, the first letter of the role and their first fault. Nulls are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("place"),
        role.alias("role"),
        text.alias("text"),
    )
    blank = ~F.col("text").rlike(_NOT_BLANK)
    # Written, since a row's place has to be the same in every step.
    rows = materialize(
        rows.withColumns(
            {
                "blank": blank,
                "ends": F.substring(F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1), 1, 1),
                "digest": F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary")),
            }
        ),
        "chat-rows",
    )
    order = F.struct("turn", "place")
    again = (
        rows.where(~F.col("blank"))
        .groupBy(F.col("conv_id").alias("a_conv"), F.col("digest").alias("a_digest"))
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("a_conv", "a_digest", F.col("first.place").alias("first"))
    )
    marked = rows.join(again, rows["conv_id"].eqNullSafe(again["a_conv"]) & (F.col("digest") == F.col("a_digest")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("first") != F.col("place"), F.lit(False))
    truncated = ~F.col("blank") & ~F.col("duplicate") & ~F.col("ends").isin(".", "!", "?")
    dropped = F.col("blank") | F.col("duplicate")
    return marked.withColumn("duplicate", duplicate).withColumn("truncated", truncated).select(
        "conv_id", "turn", "place", "role", "text", F.substring("role", 1, 1).alias("initial"),
        F.when(dropped, editsearch.DROP).when(F.col("truncated"), editsearch.TRUNCATED).otherwise(editsearch.FINE).alias("mode"),
        "blank", "truncated", "duplicate",
    )


def _code(initial: str) -> int:
    return ord(initial) if initial else 0


_LEGAL = {(_code(a), _code(b)) for a, b in ("su", "ua", "au")}


def stretch(rows: list[dict]) -> list:
    """STATS of neighbouring rows."""
    return add([_one(r) for r in rows])


def _one(r: dict) -> list:
    turn, code = r["turn"], _code(r["initial"])
    return [1, int(r["blank"]), int(r["duplicate"]), int(r["truncated"]), 0, turn, turn, int(turn is not None), code, code, turn, turn]


def add(parts: list[list]) -> list:
    """STATS of neighbouring stretches together. Rows are in order of their turns, nulls first."""
    out = list(parts[0])
    for p in parts[1:]:
        for k in range(5):
            out[k] += p[k]
        out[4] += (out[9], p[8]) not in _LEGAL
        out[7] += p[7] - (out[11] is not None and out[11] == p[10])
        out[5] = p[5] if out[5] is None else out[5]
        out[6] = out[6] if p[6] is None else p[6]
        out[9], out[11] = p[9], p[11]
    return out


def _edits(rows: list[dict], audit: str, entry: int):
    """EDIT rows; insertions have the place of the row before which they stand, at the end that of the last row."""
    k, last = 0, -1
    for i, edit, role in editsearch.apply(audit, entry, [r["role"] for r in rows]):
        at = min(i, len(rows) - 1)
        k, last = (k + 1 if at == last else 0), at
        row = rows[at]
        yield row["conv_id"], row["turn"], row["place"], k, edit, role, "" if edit == "I" else row["text"]


def cut(rows: DataFrame) -> DataFrame:
    """Rows in order, cut into blocks; see CUT."""

    def finished(block, whole, at):
        r, stats = block[0], stretch(block)
        states = [(x["initial"], x["mode"]) for x in block]
        if whole:
            cost, audit = editsearch.search(states)
            yield WHOLE, r["conv_id"], r["turn"], r["place"], None, None, None, None, None, stats, None, None, [audit], cost, None, None
            for conv_id, turn, place, k, edit, role, text in _edits(block, audit, editsearch.START):
                yield EDITED, conv_id, turn, place, k, edit, role, text, None, None, None, None, None, None, None, None
        else:
            found = editsearch.ways(states)
            audits = [w and w[1] for w in found]
            costs = [-1 if w is None else w[0] for w in found]
            tables = stats, costs, editsearch.ranks(audits), audits
            yield PIECE, r["conv_id"], r["turn"], r["place"], None, None, None, None, r["place"], *tables, None, *at
            for k, x in enumerate(block):
                yield RAW, x["conv_id"], x["turn"], x["place"], k, None, x["role"], x["text"], r["place"], None, None, None, None, None, None, None

    def run(batches):
        # begun: this conversation starts here, since another one ended before it in this partition.
        block, begun, part, at = [], False, TaskContext.get().partitionId(), 0
        for batch in batches:
            for r in batch.to_pylist():
                other = bool(block) and r["conv_id"] != block[0]["conv_id"]
                if other or len(block) == BLOCK:
                    yield from finished(block, begun and other, (part, at))
                    block, begun, at = [], other, at + 1
                block.append(r)
        if block:
            yield from finished(block, False, (part, at))

    order = ["conv_id", "turn", "place"]
    return common.map_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, CUT)


KEPT = ["conv_id", "place", "pos", "stats", "costs", "ranks"]


def combine(nodes: DataFrame) -> DataFrame:
    """Nodes of a conversation whose ``pos`` differ in the last FAN_BITS bits only, in one; see NODE."""

    def merged(group):
        costs, ranks, states = editsearch.chain([(n["costs"], n["ranks"]) for n in group])
        stats = add([n["stats"] for n in group])
        first = group[0]
        return first["conv_id"], first["place"], first["pos"] >> FAN_BITS, stats, costs, ranks, [n["place"] for n in group], states

    def run(batches):
        group = []
        for batch in batches:
            for n in batch.to_pylist():
                if group and (n["conv_id"], n["pos"] >> FAN_BITS) != (group[0]["conv_id"], group[0]["pos"] >> FAN_BITS):
                    yield merged(group)
                    group = []
                group.append(n)
        if group:
            yield merged(group)

    together = nodes.repartition("conv_id", F.shiftright("pos", FAN_BITS)).sortWithinPartitions("conv_id", "pos")
    return common.map_rows(together, run, NODE)


def choose(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, stats, cost, leaving) of each conversation, (node, entry, leaving, last) of each block).

    ``leaving`` is the state behind the last row, ``last`` marks a conversation's last block. A node is named by the place
    of its first row. Its ``pos`` grows with the partition and the block in it, and loses FAN_BITS bits on each level.
    """
    most_part, most_at = pieces.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.max("at"), F.lit(0))).first()
    width = most_at.bit_length()
    nodes, levels = pieces.withColumn("pos", F.shiftleft("part", width) + F.col("at")).select(*KEPT), []
    for _ in range(max(1, -(-(most_part.bit_length() + width) // FAN_BITS))):
        levels.append(materialize(combine(nodes), "chat-nodes"))
        nodes = levels[-1].select(*KEPT)

    def top(batches):
        for batch in batches:
            for n in batch.to_pylist():
                cost, leaving = editsearch.finish(n["costs"], n["ranks"])
                yield n["conv_id"], n["place"], n["stats"], cost, leaving

    def down(batches):
        for batch in batches:
            for n in batch.to_pylist():
                path = n["states"][editsearch.WAYS.index((n["entry"], n["leaving"]))]
                for k, child in enumerate(n["children"]):
                    yield child, path[k], path[k + 1], n["last"] and k + 1 == len(n["children"])

    tops = common.map_rows(nodes, top, TOP)
    chosen = tops.select(F.col("place").alias("node"), F.lit(editsearch.START).alias("entry"), "leaving", F.lit(True).alias("last"))
    for level in reversed(levels):
        inner = level.select(F.col("place").alias("node"), "children", "states")
        chosen = materialize(common.map_rows(chosen.join(inner, "node"), down, WAY), "chat-ways")
    return tops, chosen


def _way(entry: Column, leaving: Column) -> Column:
    return F.array_position(F.array(*[F.lit(10 * p + q) for p, q in editsearch.WAYS]), 10 * entry + leaving).cast("int")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, edits) of conversations with the columns conv_id, turn, role and text.

    report has a row for each conversation: gaps (missing turns between its least and largest), blank, duplicate and
    truncated rows by their first fault, illegal (neighbouring rows whose roles do not follow each other), cost, and
    audit, the initials of all edits in order. edits has a row for each edit, in order of turn (nulls first), place and
    k; those but D, in this order, are the repaired conversation: (role, text), an inserted row without text.

    Rows count in the order of their turns, nulls first; rows of one turn in the order of the table. Equal rows are
    duplicates but for the first. A null role or text is one space; rows with a null conv_id are a conversation. A
    role that is none of system, user, assistant (by its first letter) fits nowhere and is deleted or changed. An
    empty table gives empty results. Other columns are ignored.
    """
    parts = materialize(cut(faults(conversations)), "chat-blocks")
    pieces = parts.where(F.col("kind") == PIECE)
    tops, ways = choose(pieces)

    # The edits of each block of a cut conversation, on its way.
    closing = reduce(lambda c, q: c.when(F.col("leaving") == q, editsearch.CLOSING[q]), editsearch.CLOSING, F.when(F.lit(False), ""))
    taken = pieces.select("conv_id", "turn", "place", "node", "audits").join(ways, "node")
    taken = taken.withColumn("audit", F.concat(F.element_at("audits", _way(F.col("entry"), F.col("leaving"))), F.when(F.col("last"), closing).otherwise("")))
    taken = materialize(taken.select("conv_id", "turn", "place", "node", "entry", "audit"), "chat-audits")

    whole = parts.where(F.col("kind") == WHOLE).select("conv_id", "stats", "cost", F.col("audits")[0].alias("audit"))
    # An audit is one text of the result, as long as its conversation has rows.
    in_order = F.sort_array(F.collect_list(F.struct("turn", "place", "audit")))
    audits = taken.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda s: s["audit"]), "").alias("audit"))
    long = tops.alias("t").join(audits.alias("a"), F.col("t.conv_id").eqNullSafe(F.col("a.conv_id")))
    stat = {name: F.col("stats")[k] for k, name in enumerate(STATS)}
    report = whole.unionByName(long.select("t.conv_id", "stats", "cost", "audit")).select(
        "conv_id",
        F.coalesce(stat["most_turn"] - stat["least_turn"] + 1 - stat["turns"], F.lit(0)).alias("gaps"),
        *[stat[c].alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        "cost",
        "audit",
    )

    # A block's edits come first, its rows stream behind them.
    rows = parts.where(F.col("kind") == RAW).select("node", F.lit(1).alias("turn_of"), "conv_id", "turn", "place", "k", "role", "text")
    heads = taken.select("node", F.lit(0).alias("turn_of"), "entry", "audit")
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("node").sortWithinPartitions("node", "turn_of", "k")

    def run(batches):
        head, block = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["turn_of"] == 0:
                    if head:
                        yield from _edits(block, head["audit"], head["entry"])
                    head, block = r, []
                else:
                    block.append(r)
        if head:
            yield from _edits(block, head["audit"], head["entry"])

    schema = "conv_id long, turn long, place long, k int, edit string, role string, text string"
    edits = parts.where(F.col("kind") == EDITED).select(*EDIT).unionByName(common.map_rows(both, run, schema))
    return report, edits


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` of the repaired rows, joined by newlines.

    Rows stream past in order, one conversation after the other; a digest takes one conversation's rows in one task,
    but holds none of them.
    """

    def run(batches):
        now, state, any_row = None, None, False
        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv_id != now:
                    if state is not None:
                        yield now, state.hexdigest()
                    now, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield now, state.hexdigest()

    rows = edits.where("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "k")
    return common.map_rows(rows.select("conv_id", "role", "text"), run, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn``, modulo 20; nulls are one space there.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats the row
    next to it, 4 gives it the role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def repair_report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """The report with digests of the repaired rows, for every conv_id of ``conversations``.

    A conversation without rows in ``damaged`` has zeros, no edits and the digest of an empty text, and so has the
    digest of one that is deleted whole.
    """
    report, edits = repair(damaged)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One row for each conversation on all sides.
    first = ids.alias("i").join(report.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    both = first.join(digests(edits).alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return both.select(
        "i.conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
