"""Katz scores against a plain dictionary model over small documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowsentry.llm import common, katz

SCHEMA = "doc_id long, text string, bucket string, unit string, word string"


def brute(docs):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    texts = [(t or "").encode().lower().split() + [None] for _, t in docs]
    uni, pairs, starts = Counter(), Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            pairs.update(zip(["<s>"] + t[:-1], t))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    coc = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, katz.HIGHEST + 2)]
    model = katz.unigram(n, v, coc(uni))
    d = katz.discounts(coc(pairs))
    followers = defaultdict(dict)
    for (h, w), c in pairs.items():
        followers[h][w] = c

    def p1(w):
        c = uni[w]
        if not c:
            return model.unknown
        return (model.factors[c] if c < len(model.factors) else 1) * c / model.tokens

    def conditional(h):
        seen = followers[h]
        total = sum(seen.values())
        if not total:
            return lambda w: p1(w)
        f = lambda c: d[c] if c < len(d) else 1.0
        left = total - sum(f(c) * c for c in seen.values())
        if left <= 1e-9 * total:
            total, left = total + 1, 1.0
        a = left / total / (1 - sum(p1(w) for w in seen))
        return lambda w: f(seen[w]) * seen[w] / total if w in seen else a * p1(w)

    out = []
    for (i, _), t, h in zip(docs, texts, held):
        score = sum(math.log10(conditional(a)(w)) for a, w in zip(["<s>"] + t[:-1], t))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    vocabulary = list(uni) + ["<unknown>"]
    for h in list(followers)[:20]:
        assert sum(conditional(h)(w) for w in vocabulary) == pytest.approx(1)
    return out


def compare(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA)
    got = katz.katz_scores(df.repartition(3), common.remainder("doc_id", 7) == 2, **kw).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
    key = lambda r: tuple((x is None, x) for x in r[:4]) + (round(r[5], 6),)
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(brute(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores_equal_a_plain_model(spark):
    common.prepare(spark)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["The", "the", "É", "x y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(3, None), (4, ""), (None, "the w1"), (7, docs[7][1]), (7, docs[7][1]), (900, "the " * 5000)]
    compare(spark, docs, bucket_documents=10, unit_tokens=500)
    compare(spark, docs)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(empty, F.lit(False)).collect() == []
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.katz_scores(only, F.lit(True)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (3, 0, 0, 0.0)



def test_more_words_than_a_bucket_can_number_are_refused():
    assert katz.word_capacity(1 << 16, 1 << 16) == 1 << 16
    with pytest.raises(ValueError, match="distinct words"):
        katz.word_capacity(1 << 16, (1 << 16) + 1)
