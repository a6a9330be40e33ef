import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import common, toxicity

BAD = ["vile", "nasty", "horridly", "lostraba"]
CLEAN = [f"{a}{b}" for a in ("sun", "moon", "tree", "river", "stone") for b in ("ing", "light", "fall", "er", "")]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = rng.choices(CLEAN, k=rng.randint(20, 60))
        if bad:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "x", "en"]))
        out.append((i, " ".join(words).capitalize(), int(bad)))
    return out


def test_search_equals_brute_force():
    rows = texts(400)
    index = toxicity.build([t for _, t, _ in rows], [y for *_, y in rows], 0.25)
    assert index.terms and not any(t.rstrip("*") in CLEAN for t in index.terms)
    full = np.zeros((len(index.label), len(index.terms)))
    for t, (e, w) in enumerate(zip(index.examples, index.weights)):
        full[e, t] = w
    for _, text, _ in texts(60, seed=9):
        ids, w = toxicity.vector(toxicity.bag_of_words(text), index.terms, index.idf)
        e, s = toxicity.search(index, ids, w)
        cosine = full[:, ids] @ w if len(ids) else np.zeros(len(full))
        order = [i for i in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[i] > 1e-12][: toxicity.NEIGHBOURS]
        assert np.allclose(np.sort(s), np.sort(cosine[order]))


def test_calibration_is_monotone():
    edges, rates = toxicity.calibrate(np.array([0, 0, 0.1, 0.2, 0.3, 0.3]), np.array([0, 1, 0, 1, 0, 1]), 0.1)
    assert list(edges) == sorted(edges) and list(rates) == sorted(rates) and 0 <= rates[0] <= rates[-1] <= 1


def test_held_out_accuracy_and_edges(spark):
    common.prepare(spark)
    rows = texts(800)
    docs = [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "nasty " * 20_000), (5003, "vile"), (5003, "vile"), (None, "nasty vile")]
    labels = [(i, y, 1) for i, _, y in rows] + [(7, 0, 1), (9999, 1, 1), (None, 1, 0), (8, None, 1)]
    d = spark.createDataFrame([(*r, "toxic", 3.0) for r in docs], "doc_id long, text string, toxic string, score double")
    y = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    index = toxicity.fit(d, y, common.remainder("doc_id", 4) != 2)
    got = toxicity.score(d, index).select("*", (common.remainder("doc_id", 4) == 2).alias("held")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: v for i, _, v in rows}
    held = [(r["score"] >= 0.3, truth[r["doc_id"]] == 1) for r in got if r["held"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) >= 0.97
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[5000] == by[5001] and by[5000][0] < 0.3 and by[5002][0] >= 0.3 and len(by[5003]) == 2
    toxic = next(r for r in got if r["doc_id"] == 5002)
    shown = [e.split(":") for e in toxic["evidence"].split(",")]
    assert 1 <= len(shown) <= toxicity.SHOWN and all(truth[int(i)] == int(y) == 1 and 0 < float(c) <= 1 for i, y, c in shown)
    assert toxicity.score(d.limit(0), index).collect() == []


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    index = toxicity.fit(d, none, F.lit(True))
    assert index is None and [r["score"] for r in toxicity.score(d, index).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int")
    index = toxicity.fit(d, one, F.lit(True))
    assert [r["score"] for r in toxicity.score(d, index).collect()] == pytest.approx([0.0, 0.0])
    assert toxicity.bag_of_words("A a b") == Counter({"a": 2, "b": 1})


def test_few_examples_and_rare_terms_count():
    rng = random.Random(3)
    clean = [" ".join(rng.choices(CLEAN, k=30)) for _ in range(60)]
    bad = [f"{' '.join(rng.choices(CLEAN, k=30))} {' '.join(rng.sample(BAD, 2))}" for _ in range(5)]
    bad.append(" ".join(rng.choices(CLEAN, k=30)) + " quzzorim")  # the only example with this word
    index = toxicity.build(clean + bad, [0] * len(clean) + [1] * len(bad), 0.1)
    assert {"quzzorim", *BAD} <= index.terms.keys() and not any(t.rstrip("*") in CLEAN for t in index.terms)
    scorer = toxicity.Scorer(index)
    copy, fresh, fine = scorer(bad[-1]), scorer("tree vile river nasty stone"), scorer(clean[0])
    assert copy[1] == 1 and copy[2].startswith(f"{len(clean) + len(bad) - 1}:1:")
    assert fresh[0] >= 0.3 > fine[0]


def test_choice_of_terms_does_not_hang_on_the_number_of_examples():
    small = toxicity.strength(np.array([4.0, 1, 9]), np.array([1.0, 0, 30]), 9, 40)
    assert np.allclose(small, toxicity.strength(np.array([400.0, 100, 900]), np.array([100.0, 0, 3000]), 900, 4000))
    assert small[0] > 0 and small[1] > 0 and small[2] == 0


def test_long_example_does_not_end_the_sample(spark):
    common.prepare(spark)
    rows = texts(40)
    long = {i for i, *_ in rows if i % 8 < 2}  # of each label some
    d = spark.createDataFrame([(i, t + " x" * 5000 * (i in long)) for i, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, v, 1) for i, _, v in rows], "doc_id long, toxic int, quality int")
    index = toxicity.fit(d, y, F.lit(True), chars=9000)
    short = {(i, v) for i, _, v in rows if i not in long and v == 1}
    got = set(zip(index.ids.tolist(), index.label.tolist()))
    assert short <= got and not long & {i for i, _ in got}
    few = {v: sum(y == v for _, y in zip(*(index.ids, index.label))) for v in (0, 1)}
    again = toxicity.fit(d, y, F.lit(True), examples=3, chars=9000)
    assert few[1] == 5 and again.label.tolist() == [1, 1, 1, 0, 0, 0] and not long & set(again.ids.tolist())
