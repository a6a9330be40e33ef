"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, counts in partitioned tables.

The model is a bigram model over words and an end mark. The work moves in arrays, not in a row for each token:

1. A task reads documents and cuts them into units of about UNIT_TOKENS tokens. A unit writes its distinct words, dealt
   out by hash over the buckets, and its documents as numbers into that word list.
2. A bucket of words adds up the units' counts, numbers its words and answers every unit in the order it was asked.
3. A unit turns its documents into pairs (history, word) and deals them out by history. A history that is too frequent
   for one bucket is split by its words.
4. A bucket of pairs has all counts of its histories (of its part of a split one): it writes the table of pair counts
   and, for every history, what the backoff weight is made of.
5. With the counts of counts of all buckets the discounts are known; each bucket scores its own pairs, history by history,
   backing off where a pair is unseen, and sends each unit the sums for its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import common
from flowsentry.session import materialize

UNIT_TOKENS = 2_000_000
#: Documents for each bucket of words and of pairs; their number grows with the table, a bucket does not.
BUCKET_DOCUMENTS = 4096
#: Counts up to this one are discounted, if the counts of counts allow it.
HIGHEST = 5
#: No word holds white space, so these texts stand for the marks.
START, END = xxhash.xxh64_intdigest(b"\n\n"), xxhash.xxh64_intdigest(b"\n")


def zip_array(x: np.ndarray) -> bytes:
    """Bytes of equal place side by side: the high ones are mostly zero and shrink to nothing."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unzip_array(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def zip_sorted(x: np.ndarray) -> bytes:
    return zip_array(np.diff(x, prepend=x.dtype.type(0)))


def unzip_sorted(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unzip_array(b, kind), dtype=kind)


class Hashes(dict):
    """Word to 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors d[r] for r = 0..k (d[0] unused) from n[r], r = 0..; the greatest k for which all are in (0, 1).

    Without any such k, the factors are those of absolute discounting with n1 / (n1 + 2 n2), at least 0.1 and at most 0.9.
    """
    n = [float(x) for x in counts_of_counts]
    for k in range(min(HIGHEST, len(n) - 2), 0, -1):
        if all(n[1 : k + 2]):
            common_part = (k + 1) * n[k + 1] / n[1]
            if common_part < 1:
                d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - common_part) / (1 - common_part) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d[1:]):
                    return np.array(d)
    off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    return np.array([1.0] + [1 - off / r for r in range(1, HIGHEST + 1)])


class Unigram(NamedTuple):
    tokens: int
    words: int
    factors: np.ndarray
    unknown: float

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of a known word by its count; count 0 gets the mass the discounts have left."""
        d = np.ones(len(count))
        low = count < len(self.factors)
        d[low] = self.factors[count[low]]
        return np.where(count > 0, d * count / max(1, self.tokens), self.unknown)


def unigram(tokens: int, words: int, counts_of_counts: list[int]) -> Unigram:
    d = discounts(counts_of_counts)
    kept = sum((1 - d[r]) * r * counts_of_counts[r] for r in range(1, min(len(d), len(counts_of_counts))))
    unknown = kept / tokens if tokens else 1.0
    if unknown <= 0:  # nothing is discounted: one more token, unknown
        return Unigram(tokens + 1, words, np.ones(1), 1 / (tokens + 1))
    return Unigram(tokens, words, d, unknown)


def _by_bucket(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(sorted_hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1))


def _units(batches, bits: int, unit_tokens: int) -> Iterator[tuple]:
    """Rows (kind 0: a unit's words of one bucket with training counts; kind 1: its documents)."""
    hashes = Hashes()
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    streams, n = [], 0

    def flush():
        unit = part << 24 | number
        token = np.concatenate(streams)
        length = np.array([h[2] for h in held], np.uint32)
        train = np.array([not h[1] for h in held])
        word, index = np.unique(token, return_inverse=True)
        count = np.bincount(index[np.repeat(train, length)], minlength=len(word)).astype(np.uint32)
        edges = _by_bucket(word, bits)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[b], edges[b + 1])
            yield 0, unit, b, zip_sorted(word[own]), zip_array(count[own]), None, None
        ids = np.array([-1 if h[0] is None else h[0] for h in held], np.int64)
        flags = train.astype(np.uint8) | np.array([(h[0] is None) << 1 for h in held], np.uint8)
        yield 1, unit, -1, zip_array(index.astype(np.uint32)), zip_array(length), zip_array(ids), zip_array(flags)

    for batch in batches:
        for doc_id, held_out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held_out", "text"))):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            token = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            streams.append(np.append(token, np.uint64(END)))
            held.append((doc_id, held_out, len(words) + 1))
            n += len(words) + 1
            if n >= unit_tokens:
                yield from flush()
                number, held, streams, n = number + 1, [], [], 0
    if held:
        yield from flush()


def _number_words(key: tuple, group: pa.Table) -> pa.Table:
    """All of a bucket's words: counts added up, numbered in the order of their hashes; an answer for each unit."""
    bucket = key[0].as_py()
    units = group["unit"].to_pylist()
    word = [unzip_sorted(b, np.uint64) for b in group["a"].to_pylist()]
    count = [unzip_array(b, np.uint32) for b in group["b"].to_pylist()]
    distinct, index = np.unique(np.concatenate(word), return_inverse=True)
    total = np.bincount(index, np.concatenate(count), len(distinct)).astype(np.uint64)
    edges = np.cumsum([0, *map(len, word)])
    known = total[total > 0]
    stats = [int(known.sum()), len(known), *np.bincount(known[known <= HIGHEST + 1].astype(np.int64), minlength=HIGHEST + 2)[1:].tolist()]
    answers = [index[a:b] for a, b in zip(edges, edges[1:])]
    n = len(units) + 1
    return pa.table(
        {
            "unit": pa.array([*units, None], pa.int64()),
            "bucket": pa.array([bucket] * n, pa.int32()),
            "a": pa.array([*(zip_sorted(x.astype(np.uint32)) for x in answers), None], pa.binary()),
            "b": pa.array([*(zip_array(total[x]) for x in answers), None], pa.binary()),
            "stats": pa.array([None] * len(units) + [stats], pa.list_(pa.int64())),
        }
    )


class _Pairs(NamedTuple):
    """What a unit sends to buckets of pairs, and what the table of counts is read with."""

    buckets: int
    capacity: int
    split_at: int
    parts: int


def _pair_rows(plan: _Pairs, model: Unigram, documents: int, answers: pa.Table, body: pa.Table) -> pa.Table:
    """One unit: its documents' base scores, and its pairs by bucket."""
    bits = plan.buckets.bit_length() - 1
    unit = body["unit"][0].as_py()
    rows = sorted(answers.select(["bucket", "a", "b"]).to_pylist(), key=lambda r: r["bucket"])
    gid = np.concatenate([unzip_sorted(r["a"], np.uint32).astype(np.uint64) + np.uint64(r["bucket"] * plan.capacity) for r in rows])
    count = np.concatenate([unzip_array(r["b"], np.uint64) for r in rows])
    index = unzip_array(body["a"][0].as_py(), np.uint32)
    length = unzip_array(body["b"][0].as_py(), np.uint32).astype(np.int64)
    ids, flags = unzip_array(body["c"][0].as_py(), np.int64), unzip_array(body["d"][0].as_py(), np.uint8)
    first = np.cumsum(length) - length
    base = np.log10((count + 1.0) / (model.tokens + model.words + 1))
    base_score = np.add.reduceat(base[index], first)
    n_known = np.add.reduceat((count > 0)[index].astype(np.int64), first)
    start = np.uint64(plan.buckets * plan.capacity)  # one number beyond all words
    history = np.empty(len(index), np.uint64)
    history[1:] = gid[index[:-1]]
    history[first] = start
    history_count = np.empty(len(index), np.uint64)
    history_count[1:] = count[index[:-1]]
    history_count[first] = documents
    word, word_count = gid[index], count[index]
    doc = np.repeat(np.arange(len(length), dtype=np.uint32), length)
    bucket = np.where(history == start, 0, history // np.uint64(plan.capacity)).astype(np.int64)
    hot = history_count >= plan.split_at
    bucket[hot] = plan.buckets + (history[hot] % np.uint64(plan.buckets)).astype(np.int64) * plan.parts + (
        word[hot] % np.uint64(plan.parts)
    ).astype(np.int64)
    order = np.lexsort((word, history, bucket))
    out: list[tuple] = []
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts):
        h = history[own]
        heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[heads, len(h)]).astype(np.uint32)
        distinct, first_at, place = np.unique(word[own].astype(np.uint32), return_index=True, return_inverse=True)
        out.append(
            (
                0, unit, int(bucket[own[0]]), zip_sorted(h[heads]), zip_array(runs), zip_array(history_count[own][heads]),
                zip_sorted(distinct), zip_array(word_count[own][first_at]), zip_array(place.astype(np.uint32)),
                zip_array(doc[own]), zip_array(flags & 1),
            )
        )
    kept = (base_score, n_known, length, ids)
    out.append((1, unit, int(unit % plan.buckets), *map(zip_array, kept), zip_array(flags), None, None, None))
    names = ("kind", "unit", "bucket", *"abcdefgh")
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8)
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, zip(*out), kinds)})


def _count_pairs(plan: _Pairs, model: Unigram, group: pa.Table) -> pa.Table:
    """All pairs of a bucket: one row of counts by pair, sums by history and the documents behind them."""
    rows = group.to_pylist()
    out = [{**r, "stats": None} for r in rows if r["kind"] == 1]
    pairs = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["unit"])
    if pairs:
        history, count_h, word, count_w, doc, train, units, sizes = [], [], [], [], [], [], [], []
        base = 0
        for r in pairs:
            runs = unzip_array(r["b"], np.uint32)
            history.append(np.repeat(unzip_sorted(r["a"], np.uint64), runs))
            count_h.append(np.repeat(unzip_array(r["c"], np.uint64), runs))
            place = unzip_array(r["f"], np.uint32)
            word.append(unzip_sorted(r["d"], np.uint32)[place])
            count_w.append(unzip_array(r["e"], np.uint64)[place])
            own, flags = unzip_array(r["g"], np.uint32), unzip_array(r["h"], np.uint8)
            train.append(flags[own])
            doc.append(own.astype(np.int64) + base)
            units.append(r["unit"])
            sizes.append(len(flags))
            base += len(flags)
        history, count_h, word, count_w, doc, train = map(np.concatenate, (history, count_h, word, count_w, doc, train))
        rows = group = None
        order = np.lexsort((word, history))
        history, word = history[order], word[order]
        new_h = np.r_[True, history[1:] != history[:-1]]
        pair = np.flatnonzero(new_h | np.r_[True, word[1:] != word[:-1]])
        entries = np.diff(np.r_[pair, len(order)])
        count = np.add.reduceat(train[order].astype(np.int64), pair)
        p = model.probability(count_w[order][pair].astype(np.int64))
        of_h = np.flatnonzero(new_h[pair])
        sums = [np.add.reduceat(np.where(count == r, 1, 0), of_h) for r in range(1, HIGHEST + 1)]
        rest = np.add.reduceat(np.where(count > HIGHEST, count, 0), of_h)
        seen = np.add.reduceat(np.where(count > 0, p, 0.0), of_h)
        table = {
            "a": zip_array(np.diff(np.r_[of_h, len(pair)]).astype(np.uint32)),
            "b": zip_array(np.stack([*sums, rest, count_h[order][pair][of_h].astype(np.int64)]).astype(np.int64).ravel()),
            "c": zip_array(seen),
            "d": zip_array(entries.astype(np.uint32)),
            "e": zip_array(count.astype(np.uint32)),
            "f": zip_array(np.log10(p[count == 0])),
            "g": zip_array(doc[order].astype(np.uint32)),
        }
        h = zip_array(history[pair][of_h])
        coc = np.bincount(count[count <= HIGHEST + 1], minlength=HIGHEST + 2)[1:].tolist()
        out.append({"kind": 0, "unit": -1, "bucket": pairs[0]["bucket"], **table, "h": h, "units": units, "sizes": sizes, "stats": coc})
    names = ("kind", "unit", "bucket", *"abcdefgh", "units", "sizes", "stats")
    longs = pa.list_(pa.int64())
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8, longs, longs, longs)
    return pa.table({n: pa.array([r.get(n) for r in out], k) for n, k in zip(names, kinds)})


TABLE_SCHEMA = (
    "kind int, unit long, bucket int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, "
    "units array<long>, sizes array<long>, stats array<long>"
)


def _history_sums(row: dict) -> np.ndarray:
    """Rows: types with count 1..HIGHEST, occurrences with more, the history's count, unigram mass of its seen words."""
    counts = unzip_array(row["b"], np.int64).reshape(HIGHEST + 2, -1).astype(float)
    return np.vstack([counts, unzip_array(row["c"], np.float64)])


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, weight) by history. The weight makes the probabilities of all words after the history sum to 1.

    A history none of whose counts is discounted is counted once more, for the unseen; one that training does not
    know has denominator 0 and weight 1.
    """
    factors = np.ones(HIGHEST + 1)
    factors[1 : len(d)] = d[1:]
    r = np.arange(1, HIGHEST + 1)
    total = sums[HIGHEST + 1]
    left = total - (factors[1:, None] * r[:, None] * sums[:HIGHEST]).sum(0) - sums[HIGHEST]
    bare = (total > 0) & (left <= 1e-9 * total)
    denominator = np.where(bare, total + 1, total)
    left = np.where(bare, 1.0, left)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(total > 0, left / denominator / np.maximum(1 - sums[HIGHEST + 2], 1e-300), 1.0)
    return denominator, weight


def _score_row(row: dict, d: np.ndarray, split: dict[int, np.ndarray]) -> Iterator[tuple]:
    sums = _history_sums(row)
    if split:
        for i, h in enumerate(unzip_array(row["h"], np.uint64).tolist()):
            if h in split:
                sums[:, i] = split[h]
    denominator, weight = backoff(sums, d)
    pairs_of_h, entries = unzip_array(row["a"], np.uint32), unzip_array(row["d"], np.uint32)
    count = unzip_array(row["e"], np.uint32).astype(np.int64)
    denominator, weight = np.repeat(denominator, pairs_of_h), np.repeat(weight, pairs_of_h)
    factors = np.ones(len(count))
    low = count < len(d)
    factors[low] = d[count[low]]
    value = np.empty(len(count))
    seen = count > 0
    value[seen] = np.log10(factors[seen] * count[seen] / denominator[seen])
    value[~seen] = np.log10(weight[~seen]) + unzip_array(row["f"], np.float64)
    doc = unzip_array(row["g"], np.uint32)
    total = np.bincount(doc, np.repeat(value, entries), sum(row["sizes"]))
    at = 0
    for unit, size in zip(row["units"], row["sizes"]):
        yield unit, total[at : at + size].tobytes()
        at += size


def _finish(parts: pa.Table, base: pa.Table) -> pa.Table:
    row = base.to_pylist()[0]
    base_score, n_known = unzip_array(row["a"], np.float64), unzip_array(row["b"], np.int64)
    length, ids = unzip_array(row["c"], np.int64), unzip_array(row["d"], np.int64)
    flags = unzip_array(row["e"], np.uint8)
    score = np.zeros(len(ids))
    for b in sorted(parts["sums"].to_pylist()):
        score += np.frombuffer(b)
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=flags & 2 > 0),
            "held_out": pa.array(flags & 1 == 0),
            "n_tokens": length,
            "n_known": n_known,
            "base_score": base_score,
            "score": score,
        }
    )


def word_capacity(buckets: int, most_words: int) -> int:
    """Words a bucket can number within 32 bits for all buckets; refuses a bucket with more."""
    capacity = (1 << 32) // buckets
    if most_words > capacity:
        raise ValueError(f"{most_words} distinct words in one of {buckets} buckets, which can number {capacity}: take larger buckets")
    return capacity


def katz_scores(
    docs: DataFrame, held_out: Column, bucket_documents: int = BUCKET_DOCUMENTS, unit_tokens: int = UNIT_TOKENS
) -> DataFrame:
    """Learns from the rows of ``docs`` for which ``held_out`` is false and scores all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, the model's log10
    probability. The words fall into a power of two of buckets; there may be 2^32 / buckets distinct words in each,
    and more are refused.

    P(w | h) = d(c) c / n(h) for a pair seen c > 0 times, else a(h) P(w); P(w) = d(c) c / N for a known word, and unknown
    words share one unit of the mass the discounts leave. Lower-casing touches A-Z only; words end at ASCII white space.
    A null text is empty: one end mark. Repeated rows count and are scored as often as they come; a null doc_id counts
    like the empty text when the caller hashes it. Without training rows every token is unknown: score 0. An empty table
    gives no rows; other columns are ignored.
    """
    bits = max(2, (docs.count() // bucket_documents).bit_length())
    buckets = 1 << bits
    source = docs.select("doc_id", held_out.alias("held_out"), "text")
    units = common.map_rows(
        source,
        lambda batches: _units(batches, bits, unit_tokens),
        "kind int, unit long, bucket int, a binary, b binary, c binary, d binary",
    )
    units = materialize(units, "katz-units")
    answers = (
        units.where("kind = 0")
        .groupBy("bucket")
        .applyInArrow(_number_words, "unit long, bucket int, a binary, b binary, stats array<long>")
    )
    answers = materialize(answers, "katz-words")
    sums = [F.sum(F.get("stats", F.lit(i))) for i in range(HIGHEST + 3)]
    *stats, most_words = answers.where("stats is not null").select(*sums, F.max(F.get("stats", F.lit(1)))).first()
    stats = [x or 0 for x in stats]
    model = unigram(stats[0], stats[1], [0, *stats[2:]])
    documents = source.where("not held_out").count()
    capacity = word_capacity(buckets, most_words or 0)
    plan = _Pairs(buckets, capacity, max(1000, stats[0] // (4 * buckets)), 16)

    def pair_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        return _pair_rows(plan, model, documents, left, right)

    def count_pairs(group: pa.Table) -> pa.Table:
        return _count_pairs(plan, model, group)

    letters = ", ".join(f"{c} binary" for c in "abcdefgh")
    asked = answers.where("unit is not null").groupBy("unit")
    pairs = asked.cogroup(units.where("kind = 1").groupBy("unit")).applyInArrow(
        pair_rows, f"kind int, unit long, bucket int, {letters}"
    )
    tables = materialize(pairs.groupBy("bucket").applyInArrow(count_pairs, TABLE_SCHEMA), "katz-pairs")
    counts = tables.where("kind = 0")
    n = counts.select(*[F.sum(F.get("stats", F.lit(i))) for i in range(HIGHEST + 1)]).first()
    d = discounts([0, *(x or 0 for x in n)])
    split: dict[int, np.ndarray] = {}  # at most four times as many histories as buckets, each in `parts` parts
    for row in counts.where(F.col("bucket") >= buckets).select("b", "c", "h").toLocalIterator():
        sums = _history_sums(row.asDict())
        for i, h in enumerate(unzip_array(row["h"], np.uint64).tolist()):
            if h in split:
                total = split[h][HIGHEST + 1]
                split[h] = split[h] + sums[:, i]
                split[h][HIGHEST + 1] = total
            else:
                split[h] = sums[:, i].copy()

    def score_rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _score_row(row, d, split if row["bucket"] >= buckets else {})

    parts = common.map_rows(counts.drop("kind", "unit", "stats"), score_rows, "unit long, sums binary")
    return (
        parts.groupBy("unit")
        .cogroup(tables.where("kind = 1").groupBy("unit"))
        .applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        .withColumn("train_tokens", F.lit(stats[0]).cast("long"))
    )
