"""Exact top-k by term-at-a-time accumulation over sparse integer vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import vectors

_NONE = np.iinfo(np.int64).min


def best_of(scores: np.ndarray, best: int) -> np.ndarray:
    """Positions of the ``best`` greatest scores, ties to lower positions; ``_NONE`` never counts."""
    if len(scores) > best:
        edge = np.partition(scores, len(scores) - best)[len(scores) - best]
        above, at = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        kept = np.concatenate([above, at[: best - len(above)]])
    else:
        kept = np.arange(len(scores))
    return kept[scores[kept] != _NONE]


def accumulate(best: int, slice_queries: int = 32):
    """Search of one block: postings by term, then for each query dense scores that its terms are scattered into."""

    def search(ids, rows, query_ids, queries):
        sizes = np.array([len(r) for r in rows])
        weight = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(rows)), sizes)
        filled = weight != 0
        term, row, weight = term[filled], row[filled], weight[filled]
        order = np.argsort(term, kind="stable")
        term, row, weight = term[order], row[order], weight[order]
        heads = np.searchsorted(term, np.arange(int(sizes.max(initial=0)) + 1))
        postings = [(row[a:b], weight[a:b]) for a, b in zip(heads[:-1], heads[1:])]
        out = []
        for at in range(0, len(queries), slice_queries):
            some = queries[at : at + slice_queries]
            scores = np.zeros((len(some), len(rows)), np.int64)
            for d, (where, weights) in enumerate(postings):
                for i, q in enumerate(some):
                    if d < len(q) and q[d] and len(where):
                        if len(where) == len(rows):
                            scores[i] += q[d] * weights
                        else:
                            scores[i, where] += q[d] * weights
            for i, one in enumerate(scores):
                a, b = np.searchsorted(ids, query_ids[at + i], "left"), np.searchsorted(ids, query_ids[at + i], "right")
                one[a:b] = _NONE
                kept = best_of(one, best)
                out.append((np.full(len(kept), at + i), kept, one[kept]))
        return tuple(np.concatenate(x) for x in zip(*out))

    return search


def top_k(table: DataFrame, is_query: Column, best: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the rows of greatest inner product of floor(scale * x).

    Every row with a usable vector is scored against every query, whole; a block keeps its own best rows and the
    blocks' results are ranked again. Rows with the query's vec_id are its own and no candidates; ties go to the
    smaller vec_id. Shorter vectors count as filled up with zeros; null vec_ids and unusable vectors take no part. Scores
    are longs: components up to 2^20 and a few million terms stay exact. An empty table, or one without queries, gives no rows.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = table.where(vectors.usable() & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))
    queries = vectors.distinct_queries(rows.where(is_query))
    return vectors.block_search(rows, queries, accumulate(best), "long", best)
