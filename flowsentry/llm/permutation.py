"""Approximate nearest neighbours: a permutation index over pivots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import vectors
from flowsentry.llm.topk import best_of

#: The bounded sample the index is fitted on: the rows whose ids have the smallest hashes.
PIVOTS = 512
#: Pivots kept for each vector, nearest first.
PREFIX = 80
#: Share of a block's rows that is ranked again exactly, and the least number.
RERANK_SHARE, RERANK_LEAST = 0.3, 512
#: Queries of a block.
QUERIES = 4096


def prefixes(rows: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots in order, by cosine."""
    out = np.empty((len(rows), min(length, len(pivots))), np.int64)
    for at in range(0, len(rows), 1024):
        far = -(rows[at : at + 1024] @ pivots.T)
        out[at : at + 1024] = np.argsort(far, axis=1, kind="stable")[:, :length]
    return out


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def footrule(pivots: np.ndarray, best: int, prefix: int, share: float, least: int):
    """Search of one block: pivot inverted files, footrule distances by scattering, exact scores for the nearest."""

    def search(ids, rows, query_ids, queries):
        width = max(pivots.shape[1], max(map(len, rows)), max(map(len, queries)))
        q = _matrix(queries, width)
        # Copies of a vector are one entry of the index; the first of them by id can be among the best, no others. Rows with
        # the query's own id take no place from them.
        x, inverse = np.unique(_matrix(rows, width), axis=0, return_inverse=True)
        by_vector = np.argsort(inverse.ravel(), kind="stable")
        first = np.searchsorted(inverse.ravel()[by_vector], np.arange(len(x) + 1))
        same = np.sort(ids)
        repeats = np.searchsorted(same, query_ids, "right") - np.searchsorted(same, query_ids)
        p = np.zeros((len(pivots), width))
        p[:, : pivots.shape[1]] = pivots
        own = prefixes(x, p, prefix)
        length = own.shape[1]
        order = np.argsort(own.ravel(), kind="stable")
        heads = np.searchsorted(own.ravel()[order], np.arange(len(p) + 1))
        row, place = np.divmod(order, length)
        files = [(row[a:b], place[a:b]) for a, b in zip(heads[:-1], heads[1:])]
        keep = min(len(x), max(least, int(np.ceil(share * len(x)))))
        out = []
        for i, order in enumerate(prefixes(q, p, prefix)):
            saved = np.zeros(len(x), np.int32)  # what a shared pivot saves against the distance of strangers
            for at, pivot in enumerate(order):
                where, places = files[pivot]
                saved[where] += length - np.abs(places - at)
            near = best_of(saved, keep)
            copies = np.minimum(first[near + 1] - first[near], best + repeats[i])
            score = np.repeat((x[near] * q[i]).sum(1), copies)
            nth = np.arange(len(score)) - np.repeat(np.cumsum(copies) - copies, copies)
            found = by_vector[np.repeat(first[near], copies) + nth]
            order = np.argsort(found)
            order = order[ids[found[order]] != query_ids[i]]
            kept = order[best_of(score[order], best)]
            out.append((np.full(len(kept), i), found[kept], score[kept]))
        return tuple(np.concatenate(z) for z in zip(*out))

    return search


def nearest(
    table: DataFrame,
    is_query: Column,
    best: int = 20,
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = RERANK_SHARE,
    least: int = RERANK_LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the found rows of greatest inner product, in doubles.

    ``n_pivots`` rows (fixed by a hash of their ids, so a bounded sample) are the pivots. Every row is stood for by its
    ``prefix`` nearest pivots in order and posted under each of them; a query's footrule distance to all rows comes
    from the files of its own pivots. The nearest ``share`` of each block is ranked by the exact score. Rows with the
    query's vec_id are no candidates; ties go to the smaller vec_id. Null vec_ids and null, zero or non-finite vectors
    take no part; an empty table gives no rows.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.where(vectors.usable(zero=False) & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))
    chosen = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_pivots).collect()
    width = max((len(r["v"]) for r in chosen), default=1)
    pivots = _matrix([np.array(r["v"]) for r in chosen], width)
    pivots /= np.maximum(np.sqrt((pivots**2).sum(1, keepdims=True)), 1e-300)
    queries = vectors.distinct_queries(rows.where(is_query))
    return vectors.block_search(rows, queries, footrule(pivots, best, prefix, share, least), "double", best, block_queries=QUERIES)
