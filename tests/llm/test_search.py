import math
import random

import numpy as np
from pyspark.sql import functions as F

from flowsentry.llm import common, permutation, topk
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label string, v string, score string"


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.25] * 6) for i in range(40)]  # one common vector
    rows += [(400, None), (500, [1.0, None, 0.0]), (600, [math.nan] * 6), (700, [math.inf] * 6), (800, [0.0] * 6), (900, [1.0, 2.0])]
    rows += [(1000, []), (None, [1.0] * 6)]
    return rows


def usable(e, zero):
    return e is not None and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e))


def brute(rows, step, best, weigh, zero):
    good = [(i, weigh(e)) for i, e in rows if i is not None and usable(e, zero)]
    out = []
    for q, a in good:
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:best]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    common.prepare(spark)
    rows = rows_of()
    df = spark.createDataFrame([(i, e, "a", "b", "c") for i, e in rows], SCHEMA).repartition(3)
    weigh = lambda e: [math.floor(1024 * float(np.float32(x))) for x in e]
    want = brute(rows, 100, 10, weigh, True)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_blocks_do_not_matter(spark):
    from flowsentry.llm import vectors

    rows = [(i, [i % 7, i % 5, i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = df.where("vec_id % 9 = 0")
    one, many = (
        sorted(map(tuple, vectors.block_search(df, queries, topk.accumulate(7), "long", 7, a, b).collect()))
        for a, b in ((8192, 1024), (16, 5))
    )
    assert one == many and len(one) == 23 * 7


def test_nearest_with_all_ranked_again_is_exact(spark):
    rows = rows_of(2)
    df = spark.createDataFrame([(i, e, "a", "b", "c") for i, e in rows], SCHEMA)
    got = sorted(map(tuple, permutation.nearest(df, F.col("vec_id") % 20 == 0, share=1.0).collect()))
    want = brute(rows, 20, 20, lambda e: [float(np.float32(x)) for x in e], False)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])
    assert permutation.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = permutation.nearest(df, F.col("vec_id") % 20 == 0, least=50).collect()
    data = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = brute(data, 20, 20, lambda e: e, False)
    hit = {(r["query_id"], r["vec_id"]) for r in got} & {(r[0], r[2]) for r in want}
    assert len(hit) >= 0.9 * len(want)


def test_repeated_query_rows_leave_room_for_copies(spark):
    common.prepare(spark)
    rows = [(20, [1.0, 0.5])] * 30 + [(100 + i, [1.0, 0.5]) for i in range(1, 20)] + [(200 + i, [0.5, i / 10]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, permutation.nearest(df, F.col("vec_id") == 20, best=5, share=1.0).collect()))
    assert [(q, rank, i) for q, rank, i, _ in got] == [(20, r, 100 + r) for r in range(1, 6)]
