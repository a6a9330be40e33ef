"""A stated set of query vectors against all rows, in blocks: what the two searches have in common."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of queries; a task holds one of each.
ROWS, QUERIES = 8192, 1024


def usable(vector: str = "embedding", zero: bool = True) -> Column:
    """Not null, without null or non-finite components and, unless ``zero``, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & (F.lit(zero) | F.exists(v, lambda x: x != 0)), F.lit(False))


def block_search(
    rows: DataFrame,
    queries: DataFrame,
    search: Callable[[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score: str,
    best: int,
    block_rows: int = ROWS,
    block_queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``best`` results of ``search`` over all blocks, ties to smaller vec_id.

    Both tables have (vec_id, v). Rows and queries are dealt into blocks by a hash of their row, each pair of blocks
    meets in one task, and ``search(ids, vectors, query_ids, query_vectors)`` returns arrays (query position, row
    position, score) of the block's own best results, which are then merged by a second ranking.
    """

    def blocks(table: DataFrame, size: int) -> int:
        return max(1, -(-table.count() // size))

    n_rows, n_queries = blocks(rows, block_rows), blocks(queries, block_queries)

    def dealt(table: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_own)).cast("int")
        return table.select(mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), "vec_id", "v")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = left["vec_id"].to_numpy(), (np.zeros(0, np.int64),) * 3
        query_ids = right["vec_id"].to_numpy()
        if len(ids) and len(query_ids):
            order = np.argsort(ids, kind="stable")
            found = search(ids[order], _lists(left["v"], order), query_ids, _lists(right["v"], np.arange(len(query_ids))))
            ids = ids[order]
        q, r, s = found
        return pa.table({"query_id": pa.array(query_ids[q]), "vec_id": pa.array(ids[r]), "score": pa.array(s)}).cast(out)

    kind = {"long": pa.int64(), "double": pa.float64()}[score]
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])
    found = (
        dealt(rows, "block", n_rows, "query_block", n_queries)
        .groupBy("block", "query_block")
        .cogroup(dealt(queries, "query_block", n_queries, "block", n_rows).groupBy("block", "query_block"))
        .applyInArrow(cell, f"query_id long, vec_id long, score {score}")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def _lists(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    values = [x for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    return [values[i] for i in order.tolist()]


def distinct_queries(queries: DataFrame) -> DataFrame:
    """A repeated vec_id is asked once, with the least of its vectors."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))
