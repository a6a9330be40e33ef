import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from flowsentry.llm import common, editsearch, queries, repair
from tests.llm.conftest import SF_SMALL


def best_edits(rows, entry=0, goal=editsearch.DONE):
    """(cost, edits) by trying everything from the end on; rows are (initial, extra cost or None for must go)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = ["", "s", "u", "a"]

    @lru_cache(None)
    def go(i, last, inserted):
        found = []
        if i == len(rows):
            if goal == editsearch.DONE and last in ("", "a") or goal != editsearch.DONE and last == names[goal]:
                found.append((0, ""))
            if goal == editsearch.DONE and inserted < 3:
                found.append((2, "I", go(i, after[last], inserted + 1)))
        else:
            initial, extra = rows[i]
            found.append((3, "D", go(i + 1, last, 0)))
            if inserted < 4:
                found.append((2, "I", go(i, after[last], inserted + 1)))
            if extra is not None:
                if initial == after[last] or (initial, last) == ("s", ""):
                    found.append((extra, "K", go(i + 1, initial, 0)))
                found.append((2 + extra, "R", go(i + 1, after[last], 0)))
        ways = [f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found if len(f) == 2 or f[2]]
        return min(ways, default=None)

    return go(0, names[entry], 0)


MODES = {editsearch.FINE: 0, editsearch.TRUNCATED: 1, editsearch.DROP: None}


def random_rows(rng, n):
    return [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]


def test_search_equals_brute_force():
    rng = random.Random(1)
    for t in range(4000):
        rows = random_rows(rng, rng.randint(0, 8))
        extra = [(c, MODES[m]) for c, m in rows]
        assert editsearch.search(rows) == best_edits(extra), rows
        if t % 10 == 0 and rows:
            for p in range(4):
                for q in range(4):
                    want = best_edits(extra, p, q)
                    assert editsearch.search(rows, p, q) == want, (rows, p, q)
                    assert want is None or (p, q) in editsearch.WAYS


def test_blocks_equal_one_search():
    rng = random.Random(2)
    for _ in range(400):
        n, k = rng.randint(1, 14), rng.randint(1, 5)
        rows = random_rows(rng, n)
        found = [editsearch.ways(rows[i : i + k]) for i in range(0, n, k)]
        nodes = [([-1 if w is None else w[0] for w in b], editsearch.ranks([w and w[1] for w in b])) for b in found]
        pairs = [editsearch.chain(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        costs, rank, states = editsearch.chain([p[:2] for p in pairs])
        cost, end = editsearch.finish(costs, rank)
        path, way = [0], states[editsearch.WAYS.index((0, end))]
        for p, a, b in zip(pairs, way, way[1:]):
            path += p[2][editsearch.WAYS.index((a, b))][1:]
        audit = "".join(b[editsearch.WAYS.index(ab)][1] for b, ab in zip(found, zip(path, path[1:])))
        assert (cost, audit + editsearch.CLOSING[end]) == editsearch.search(rows), rows


def test_long_run_of_one_role():
    rows = [("u", editsearch.FINE)] * 500
    cost, audit = editsearch.search(rows)
    assert (cost, audit) == (500, "KR" * 250)


SPACE = " \t\n\x0b\x0c\r"


def brute(rows, ids):
    """rows: (conv_id, turn, role, text) in the order of the table."""
    out = []
    for conv in ids:
        mine = [(t, r, x) for c, t, r, x in rows if c == conv]
        mine = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in mine]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, states, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            states.append((role[:1], None if fault in ("blank", "duplicate") else 1 if fault else 0))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [s for s, _ in states]
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
        cost, audit = best_edits(tuple(states))
        left, last, repaired = list(mine), "", []
        for e in audit:
            row = None if e == "I" else left.pop(0)
            if e == "D":
                continue
            role = row[1] if e == "K" else {"a": "user", "u": "assistant"}.get(last, "user")
            last = role[:1]
            repaired.append(f"{role}:{'' if row is None else row[2]}")
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in repaired))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def collected(report):
    return sorted((tuple(r) for r in report.select(*COLUMNS).collect()), key=str)


def random_table(rng):
    rows = []
    for conv in [*range(40), None]:
        n = rng.choice([0, 1, 3, 8, 30]) if conv != 7 else 150
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", "", None, role]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "no", "", " \t", None, "\xa0", "so!\n", f"own {turn}.", f"own {turn}?", f"𝒳 {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


@pytest.mark.parametrize("block, fan", [(64, 6), (3, 1)])
def test_repair_in_spark(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN_BITS", fan)
    common.prepare(spark)
    rows = random_table(random.Random(block))
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, node int, audit string")
    df = df.coalesce(1)
    ids = sorted({r[0] for r in rows}, key=str)
    assert collected(repair.repair_report(df, df)) == sorted(brute(rows, ids), key=str)
    report, edits = repair.repair(df)
    audits = {r["conv_id"]: r["audit"] for r in report.collect()}
    told = {}
    for r in edits.orderBy("conv_id", "turn", "place", "k").collect():
        told[r["conv_id"]] = told.get(r["conv_id"], "") + r["edit"]
    assert told == {c: a for c, a in audits.items() if a}


def test_one_conversation_of_all_rows(spark, monkeypatch):
    """A single conversation, cut into many blocks over all partitions and three levels of nodes."""
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "FAN_BITS", 2)
    common.prepare(spark)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{t}.", "x", f"{t}"])) for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = repair.repair_report(df, df).collect()
    (r,) = repair.repair(df)[0].collect()
    states, seen = [], set()
    for _, _, role, text in rows:
        states.append((role[0], editsearch.DROP if (role, text) in seen else editsearch.FINE if text[-1] == "." else editsearch.TRUNCATED))
        seen.add((role, text))
    assert (got["cost"], got["audit"]) == (r["cost"], r["audit"]) == editsearch.search(states)


def test_empty_and_damage(spark):
    common.prepare(spark)
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair.repair_report(empty, empty).collect() == []
    rows = [(c, t, "assistant", f"a. b! {t}?") for c in range(30) for t in [*range(9), None]] + [(None, None, None, None), (None, 3, "system", None)]
    kept, want = spark.createDataFrame(rows, schema).coalesce(1), []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    assert list(map(tuple, repair.damage(kept).collect())) == want
    # All rows gone: zeros and the digest of nothing.
    none = collected(repair.repair_report(kept, empty))
    assert len(none) == 31 and {r[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in repair.damage(common.table(spark, SF_SMALL, "conversations").coalesce(1)).collect()]
    ids = {r[0] for r in common.table(spark, SF_SMALL, "conversations").select("conv_id").collect()}
    assert collected(queries.op12_conversation_repair(spark, SF_SMALL)) == sorted(brute(rows, ids), key=str)
