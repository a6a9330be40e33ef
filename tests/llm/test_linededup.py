import random
from collections import Counter

import duckdb
import numpy as np

from flowsentry.llm import common, linededup, linehash, queries
from tests.llm.conftest import SF_SMALL


def halves(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, (2, n), np.uint64)


def test_perfect_hash():
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        high, low = halves(n, n)
        hashed = linehash.PerfectHash.build(high, low)
        assert sorted(hashed.places(high, low).tolist()) == list(range(n))
        # Under four bits a key.
        assert n < 1000 or len(hashed.bits) * 64 < 4.2 * n
    # Keys that share one half.
    high, low = np.zeros(5000, np.uint64), np.arange(5000, dtype=np.uint64)
    assert sorted(linehash.PerfectHash.build(high, low).places(high, low).tolist()) == list(range(5000))
    assert sorted(linehash.PerfectHash.build(low, high).places(low, high).tolist()) == list(range(5000))


def test_counts_and_strangers():
    high, low = halves(30_000, 1)
    counts = np.arange(30_000) % 700 + 1
    index = linehash.CountIndex.load(*linehash.CountIndex.build(high, low, counts, "<u1").dump(), "<u1")
    assert index.count(high, low).tolist() == np.minimum(counts, 255).tolist()
    assert index.count(*halves(30_000, 2)).max() == 0
    assert linehash.CountIndex.build(*halves(0, 0), np.zeros(0, int), "<u1").count(*halves(3, 3)).tolist() == [0, 0, 0]
    assert [linehash.counter_kind(n) for n in (1, 255, 256, 70_000, 1 << 40)] == ["<u1", "<u1", "<u2", "<u4", "<u8"]


def brute(docs, least, least_chars):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    texts = [(i, (t or "").split("\n")) for i, t in docs]
    seen = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    out = []
    for i, lines in texts:
        kept = [x for x in lines if len(key(x)) < least_chars or seen[key(x)] < least]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, docs, least, least_chars=1):
    common.prepare(spark)
    df = spark.createDataFrame([(i, t, 7, b"x", "u") for i, t in docs], "doc_id long, text string, unit int, body binary, high string")
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(df, least, least_chars).collect())


def test_lines_in_spark(spark, monkeypatch):
    monkeypatch.setattr(linededup, "UNIT_DOCUMENTS", 16)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 64)
    rng = random.Random(3)
    pool = ["All rights", " all RIGHTS\t", "Straße", "STRASSE", "É", "é", "", " ", "\x1fa", "\xa0a", "a", "\r", "x" * 50, "𝒳y", "a\x0b"]
    pool += [f"line {k}" for k in range(400)]
    docs = [(k, "\n".join(rng.choices(pool[: rng.choice([9, 15, 415])], k=rng.randint(0, 9)))) for k in range(300)]
    docs += [(None, None), (None, "a"), (500, ""), (500, ""), (501, "a\na\nb"), (501, "a\na\nb"), (502, "\n" * 300), (503, "all rights\n" * 4000 + "own")]
    for least, chars in ((10, 1), (2, 1), (1, 1), (3, 2), (300, 1)):
        assert run(spark, docs, least, chars) == brute(docs, least, chars)


def test_one_line_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(linededup, "UNIT_DOCUMENTS", 64)
    docs = [(k, f"shared\nown {k}") for k in range(2000)]
    common.prepare(spark)
    lines = linededup.unit_lines(linededup.by_unit(spark.createDataFrame(docs, "doc_id long, text string")), 1)
    # One row for each unit, not for each document.
    assert lines.count() <= 2000 + 2000 // 64 + 1
    assert run(spark, docs, 10) == brute(docs, 10, 1)


def test_empty_table(spark):
    assert run(spark, [], 10) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    rel = con.execute(queries.OP11_SQL)
    names = [d[0] for d in rel.description]
    want = sorted(tuple(r[names.index(c)] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in rel.fetchall())
    got = queries.op11_line_dedup(spark, SF_SMALL).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 0
