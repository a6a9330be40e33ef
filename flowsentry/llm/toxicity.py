"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes, calibration."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common
from flowsentry.llm.words import Recent
from flowsentry.session import materialize

#: The bounded sample the neighbours come from: at most so many examples of each label, in the order of a hash of
#: their texts, and at most so many characters of each label.
EXAMPLES, EXAMPLE_CHARS = 2000, 16_000_000
#: Word beginnings of these lengths are terms beside the whole words.
STEMS = (4, 5, 6)
#: A term is kept if no example of label 0 has it, however rare it is, or if its log-likelihood ratio against the labels
#: reaches the first value an example and its share among label 1 is so many times that among label 0. Kept terms below
#: the first value weigh less.
ASSOCIATION, LIFT = 0.01, 2
NEIGHBOURS, SHOWN, BLOCK = 15, 3, 64
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def association(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of the 2 x 2 tables (term or not, label 1 or 0), negative where label 0 has more of it."""
    total = n1 + n0
    out = np.zeros(len(df1))
    for seen, size in ((df1, n1), (df0, n0)):
        for k, share in ((seen, (df1 + df0) / total), (size - seen, 1 - (df1 + df0) / total)):
            out += 2 * k * np.log(np.maximum(k, 1e-12) / np.maximum(size * share, 1e-12))
    return np.where(df1 * n0 >= df0 * n1, out, -out)


def strength(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far terms speak for label 1, up to 1; 0 for those that are not kept. Does not hang on the number of examples."""
    df1, df0 = np.maximum(df1, 0), np.maximum(df0, 0)
    ratio = association(df1, df0, max(n1, 1), max(n0, 1)) / (ASSOCIATION * max(n1 + n0, 1))
    leans = (df0 == 0) | ((ratio >= 1) & (df1 * max(n0, 1) >= LIFT * df0 * max(n1, 1)))
    return np.where((df1 > 0) & leans, np.sqrt(np.clip(ratio, 1e-6, 1)), 0.0)


class Index(NamedTuple):
    """Postings (example, weight) by term, for each term and block of examples the greatest weight and the place of its
    postings, and the votes."""

    terms: dict[str, int]
    idf: np.ndarray
    places: np.ndarray
    values: np.ndarray
    block_max: np.ndarray
    heads: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    edges: np.ndarray
    rates: np.ndarray

    @property
    def examples(self) -> list[np.ndarray]:
        return [self.places[a:b] for a, b in self.heads[:, [0, -1]].tolist()]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.values[a:b] for a, b in self.heads[:, [0, -1]].tolist()]


def build(texts: list[str], labels: list[int], prior: float, names: list[int] | None = None) -> Index:
    label = np.array(labels, np.int8)
    n1, n0 = int(label.sum()), int((1 - label).sum())
    bags = [bag_of_words(t) for t in texts]
    df = (Counter(), Counter())
    for bag, y in zip(bags, labels):
        df[y].update({t for w in bag for t in terms_of(w)})
    seen = sorted(df[1])
    df1, df0 = (np.array([df[y][t] for t in seen], float) for y in (1, 0))
    kept = strength(df1, df0, n1, n0) > 0
    # What would be kept without one example that has the term: an example must not choose the terms it is judged by.
    without = strength(df1, df0 - 1, n1, n0 - 1) > 0, strength(df1 - 1, df0, n1 - 1, n0) > 0
    chosen = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept & without[0])])
    every = {seen[i]: k for k, i in enumerate(chosen.tolist())}
    usable = [set(np.flatnonzero(w[chosen]).tolist()) for w in without]
    idf = (1 + np.log(len(texts) / (df1 + df0))) * np.where(kept, strength(df1, df0, n1, n0), strength(df1, df0 - 1, n1, n0 - 1))
    idf = idf[chosen]
    numbers = Recent(lambda w: tuple(every[t] for t in terms_of(w) if t in every), 300_000, 64)
    order = np.argsort(-label, kind="stable")  # blocks of one label keep their bounds tight
    vectors = [vector(bags[i], every, idf, numbers.__getitem__) for i in order.tolist()]
    at = np.repeat(np.arange(len(texts), dtype=np.int32), [len(ids) for ids, _ in vectors])
    term, value = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
    by = np.argsort(term, kind="stable")
    term, places, values = term[by], at[by], value[by]
    blocks = -(-len(texts) // BLOCK)
    cell = term * blocks + places // BLOCK
    block_max = np.zeros(len(every) * blocks)
    np.maximum.at(block_max, cell, values)
    heads = np.searchsorted(cell, np.arange(len(every))[:, None] * blocks + np.arange(blocks + 1)).astype(np.int32)
    index = Index(every, idf, places, values, block_max.reshape(len(every), blocks), heads, label[order], np.array(names or range(len(texts)), np.int64)[order], np.zeros(0), np.zeros(0))
    votes = np.array([
        vote(index, bags[i], leave=place, lookup=lambda w, own=usable[labels[i]]: [t for t in numbers[w] if t in own])
        for place, i in enumerate(order.tolist())
    ])
    edges, rates = calibrate(votes, label[order], prior)
    n = int(kept.sum())
    end = int(heads[n - 1, -1]) if n else 0
    return index._replace(
        terms=dict(list(every.items())[:n]), idf=idf[:n], places=places[:end], values=values[:end],
        block_max=index.block_max[:n].copy(), heads=heads[:n].copy(), edges=edges, rates=rates,
    )


def bag_of_words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def vector(bag: Counter, terms: dict[str, int], idf: np.ndarray, lookup=None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of unit length. Words outside the terms count as one rare term each towards the length."""
    tf: dict[int, int] = {}
    lookup = lookup or (lambda w: [terms[t] for t in terms_of(w) if t in terms])
    for w, n in bag.items():
        for t in lookup(w):
            tf[t] = tf.get(t, 0) + n
    if not tf:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.fromiter(tf, np.int64, len(tf))
    w = (1 + np.log(np.fromiter(tf.values(), float, len(tf)))) * idf[ids]
    return ids, w / np.sqrt((w * w).sum() + len(bag))


def search(index: Index, ids: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The nearest examples by cosine, exactly: blocks in the order of their upper bounds until none can enter."""
    bound = w @ index.block_max[ids]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    found_e, found_s, edge = np.zeros(0, np.int64), np.zeros(0), 0.0
    for at in range(0, len(order), 8):
        blocks = order[at : at + 8]
        blocks = blocks[bound[blocks] >= edge]
        if not len(blocks):
            break
        k, i = np.nonzero(index.block_max[np.ix_(ids, blocks)])
        start = index.heads[ids[k], blocks[i]]
        n = index.heads[ids[k], blocks[i] + 1] - start
        own = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        to = index.places[own] + np.repeat((i - blocks[i]) * BLOCK, n)
        score = np.bincount(to, np.repeat(w[k], n) * index.values[own], len(blocks) * BLOCK)
        e = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        hit = (score > 0) & (e != leave)
        found_e, found_s = np.concatenate([found_e, e[hit]]), np.concatenate([found_s, score[hit]])
        best = np.lexsort((found_e, -found_s))[:NEIGHBOURS]
        found_e, found_s = found_e[best], found_s[best]
        if len(found_s) == NEIGHBOURS:
            edge = found_s[-1]
    return found_e, found_s


def vote(index: Index, bag: Counter, leave: int = -1, lookup=None) -> float:
    """Similarity-weighted share of label 1 among the nearest, times their mean similarity; 0 without a neighbour."""
    ids, w = vector(bag, index.terms, index.idf, lookup)
    if not len(ids):
        return 0.0
    e, s = search(index, ids, w, leave)
    return float((s * index.label[e]).sum() / NEIGHBOURS) if len(e) else 0.0


def calibrate(votes: np.ndarray, label: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rates of label 1 by vote (pool adjacent violators), the labels weighted back to their share ``prior``."""
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    weight = np.where(label == 1, prior / n1, (1 - prior) / n0)
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(votes[order].tolist(), label[order].tolist(), weight[order].tolist()):
        pools.append([v, w * y, w])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def draw(rows: DataFrame, examples: int, chars: int) -> list[int]:
    """Ids of (doc_id, n, at) in the order of ``at``, as many as ``examples`` and ``chars`` allow; each is taken if it fits."""
    ids, left, rest = [], chars, F.lit(True)
    while len(ids) < examples:
        some = rows.where(rest & (F.col("n") <= left)).orderBy("at", "doc_id").limit(examples).collect()
        for r in some:
            if r["n"] <= left and len(ids) < examples:
                ids.append(r["doc_id"])
                left -= r["n"]
        if len(some) < examples:
            break
        last = some[-1]
        rest = (F.col("at") > last["at"]) | ((F.col("at") == last["at"]) & (F.col("doc_id") > last["doc_id"]))
    return ids


def fit(docs: DataFrame, labels: DataFrame, usable: Column, examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Index | None:
    """The index over a bounded sample of the labelled rows for which ``usable`` (over doc_id) holds.

    Of each label, the first ``examples`` rows in the order of a hash of the id are taken whose texts sum up to at most
    ``chars`` characters; a text that does not fit is passed over. Shares of the labels are counted over all usable labelled rows. None without labels.
    """
    known = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return None
    size = F.char_length(F.coalesce("text", F.lit("")))
    sizes = docs.groupBy("doc_id").agg(F.max(size).alias("n"))
    drawn = materialize(known.join(sizes, "doc_id").withColumn("at", F.xxhash64("doc_id")), "example-sizes")
    taken, of, named = [], [], []
    for y in sorted(counts):
        ids = draw(drawn.where(F.col("toxic") == y), examples, chars)
        some = docs.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.max("text").alias("text")).collect()
        some.sort(key=lambda r: r["doc_id"])
        taken += [r["text"] or "" for r in some]
        named += [r["doc_id"] for r in some]
        of += [y] * len(some)
    return build(taken, of, counts.get(1, 0) / sum(counts.values()), named) if taken else None


class Scorer:
    """Scores of texts, with what a worker remembers of the words it has met."""

    def __init__(self, index: Index | None):
        self.index = index
        if index is not None:
            terms = index.terms
            self.numbers = Recent(lambda w: tuple(terms[t] for t in terms_of(w) if t in terms), 100_000, 64)
            # Most texts hold no term at all; that shows between white space, before the text is cut into words.
            self.telling = Recent(lambda s: any(map(self.numbers.__getitem__, _WORD.findall(s.lower()))), 300_000, 64)

    def __call__(self, text: str | None) -> tuple[float, int, str]:
        """(score, number of neighbours, the nearest of them as id:label:cosine)"""
        index = self.index
        if index is None:
            return 0.0, 0, ""
        value, n, evidence = 0.0, 0, ""
        if any(map(self.telling.__getitem__, (text or "").split())):
            ids, w = vector(bag_of_words(text), index.terms, index.idf, self.numbers.__getitem__)
            e, s = search(index, ids, w)
            value, n = float((s * index.label[e]).sum() / NEIGHBOURS), len(e)
            nearest = zip(index.ids[e[:SHOWN]].tolist(), index.label[e[:SHOWN]].tolist(), s[:SHOWN].tolist())
            evidence = ",".join(f"{i}:{y}:{c:.4f}" for i, y, c in nearest)
        at = max(0, int(np.searchsorted(index.edges, value, "right")) - 1)
        return float(index.rates[at]), n, evidence


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """(doc_id, score, neighbours, evidence): the calibrated share of label 1, and what it rests on.

    ``neighbours`` is the number of labelled examples with a cosine above zero that voted (at most NEIGHBOURS), ``evidence``
    the nearest SHOWN of them as id:label:cosine, comma-joined. A text
    without any term, empty and null texts among them, gets the rate of such texts. Without an index every score is 0.
    Of examples with equal cosines the one of smaller number in the index comes first. Rows and their order do not matter to
    each other; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def rows(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                yield doc_id, *scorer(text)

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, score double, neighbours long, evidence string")


def below(docs: DataFrame, index: Index | None, limit: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``limit``; decided where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t)[0] < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
