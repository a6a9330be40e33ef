"""Second-order boosted trees for binary labels: L2 on leaf weights, minimum Hessian weight of a child, row and column samples.

Rows stay in Spark. Features are cut into at most 256 bins once; a level of a tree is one aggregate of gradients and
Hessians by (node, feature, bin), combined in each task before the shuffle, so what reaches the driver is bounded by
nodes x features x bins, whatever the number of rows. The sums are integers (fixed point) and the draw of a row follows
from its values, so with equal cuts a model does not depend on how the rows are partitioned.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import materialize

#: Gradients and Hessians are summed as multiples of 2^-28; 64 bits then hold the sums of 2^34 rows.
UNIT = float(1 << 28)
#: Margins are written anew after so many trees; until then each pass adds the trees grown since.
STORE_EVERY = 10


class Settings(NamedTuple):
    """The defaults are those of the training job."""

    step: float = 0.06
    max_depth: int = 6
    min_child_weight: float = 3.0
    l2: float = 1.0
    row_share: float = 0.85
    column_share: float = 0.85
    max_bins: int = 256


class Tree:
    """A binary tree in heap order (root 1, children 2i and 2i + 1); ``feature`` is -1 in leaves."""

    def __init__(self, depth: int):
        size = 2 << depth
        self.depth = depth
        self.feature = np.full(size, -1, np.int16)
        self.cut = np.zeros(size)
        self.value = np.zeros(size)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Node each row ends in. A value above the cut goes right; one that is missing (NaN) goes left."""
        at, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            feature = self.feature[at]
            right = x[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(feature >= 0, 2 * at + right, at)
        return at


class Booster(NamedTuple):
    """Log-odds ``base`` plus the leaf values of all trees over ``features`` (cuts are feature values)."""

    features: list[str]
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.nodes(x)]
        return out

    def probability(self) -> Column:
        """Probability of label 1, from 32-bit features as in training; null features count as missing."""
        model = self

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                x = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
                yield pd.Series(1 / (1 + np.exp(-model.margin(x))))

        return score(*[F.col(f).cast("float").cast("double") for f in self.features])

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row for each node, and one of tree -1 that holds the base; bounded by rounds x nodes of a tree."""
        found = [(-1, 1, None, None, float(self.base))]
        for k, tree in enumerate(self.trees):
            open_nodes = [1]
            while open_nodes:
                n = open_nodes.pop()
                split = tree.feature[n] >= 0
                name = self.features[tree.feature[n]] if split else None
                found.append((k, n, name, float(tree.cut[n]) if split else None, float(tree.value[n])))
                open_nodes += [2 * n, 2 * n + 1] if split else []
        return spark.createDataFrame(found, "tree int, node int, feature string, cut double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, features: list[str]) -> Booster:
        stored = spark.read.parquet(path).collect()
        base = next(r["value"] for r in stored if r["tree"] < 0)
        stored = [r for r in stored if r["tree"] >= 0]
        trees = []
        for k in range(1 + max((r["tree"] for r in stored), default=-1)):
            mine = [r for r in stored if r["tree"] == k]
            tree = Tree(max(r["node"] for r in mine).bit_length() - 1)
            for r in mine:
                tree.value[r["node"]] = r["value"]
                if r["feature"] is not None:
                    tree.feature[r["node"]], tree.cut[r["node"]] = features.index(r["feature"]), r["cut"]
            trees.append(tree)
        return Booster(list(features), base, trees)


class Fitted(NamedTuple):
    """The model up to its best round, that round from 0, its log loss per validation row, and the loss after each round."""

    model: Booster
    best_iteration: int
    best_score: float
    losses: list[float]


def _cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 different cuts of each feature, at its approximate quantiles."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    finite = [F.when(F.abs(f) < float("inf"), F.col(f).cast("double")) for f in features]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"_{i}") for i, c in enumerate(finite)]).first()
    return [np.unique(np.array(q if q else [], float)) for q in found]


def _binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], base: float) -> DataFrame:
    """(b0.., y, held, draw, margin): the bin is the number of cuts below the value, 0 if it is missing."""
    names = [f"b{i}" for i in range(len(features))]
    # The draw of a row follows from all its columns, not from where it is read.
    source = rows.select(
        *[F.col(f).cast("float").cast("double").alias(n) for f, n in zip(features, names)],
        (F.col("label") > 0).alias("y"), F.col("is_val").alias("held"), F.xxhash64(*rows.columns).alias("draw"),
    )

    def encode(batches):
        for batch in batches:
            columns = []
            for name, cut in zip(names, cuts):
                x = batch[name].to_numpy(zero_copy_only=False)
                columns.append(pa.array(np.where(np.isnan(x), 0, np.searchsorted(cut, x)).astype(np.int16)))
            margin = pa.array(np.full(batch.num_rows, base))
            yield pa.RecordBatch.from_arrays(
                [*columns, batch["y"], batch["held"], batch["draw"], margin], [*names, "y", "held", "draw", "margin"]
            )

    kinds = ", ".join(f"{n} short" for n in names)
    return source.mapInArrow(encode, f"{kinds}, y boolean, held boolean, draw long, margin double")


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.column_stack([batch[f"b{i}"].to_numpy() for i in range(features)])


def _with_trees(batch: pa.RecordBatch, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    margin = batch["margin"].to_numpy().copy()
    for tree in trees:
        margin += tree.value[tree.nodes(x)]
    return margin


def _in_sample(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """A new draw for each seed: the hash of a row mixed with it."""
    z = draw.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * (1 << 53)


def _sums(table: DataFrame, width: int, bins: int, done: list[Tree], tree: Tree, nodes: list[int], columns: list[int], draw: int, share: float):
    """Sums of gradients and Hessians, [node, column, bin], and (loss, rows) of the held rows under ``done``."""
    number = np.full(len(tree.feature), -1)
    number[nodes] = np.arange(len(nodes))
    size = len(nodes) * len(columns) * bins

    def collect(batches):
        g, h, loss, held_rows = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
        for batch in batches:
            x, y = _matrix(batch, width), batch["y"].to_numpy(zero_copy_only=False).astype(float)
            margin = _with_trees(batch, x, done)
            p = 1 / (1 + np.exp(-margin))
            held = batch["held"].to_numpy(zero_copy_only=False).astype(bool)
            q = np.clip(np.where(y > 0, p, 1 - p)[held], 1e-15, 1.0)
            loss += int(np.rint(-np.log(q) * UNIT).astype(np.int64).sum())
            held_rows += len(q)
            used = ~held & _in_sample(batch["draw"].to_numpy(), draw, share)
            at = number[tree.nodes(x)]
            used &= at >= 0
            gradient, hessian = np.rint((p - y)[used] * UNIT), np.rint((p * (1 - p))[used] * UNIT)
            first = at[used] * len(columns)
            for k, c in enumerate(columns):
                # Sums of integers below 2^53 in one batch, so exact.
                place = (first + k) * bins + x[used, c]
                g += np.bincount(place, gradient, size).astype(np.int64)
                h += np.bincount(place, hessian, size).astype(np.int64)
        place = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(place, -1)), pa.array(np.append(g[place], loss)), pa.array(np.append(h[place], held_rows))], ["at", "g", "h"]
        )

    parts = table.mapInArrow(collect, "at long, g long, h long")
    got = parts.groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    at, g, h = (got[c].to_numpy() for c in ("at", "g", "h"))
    sums = np.zeros((2, size))
    sums[0, at[at >= 0]], sums[1, at[at >= 0]] = g[at >= 0] / UNIT, h[at >= 0] / UNIT
    held = (g[at < 0].sum() / UNIT, int(h[at < 0].sum()))
    return sums.reshape(2, len(nodes), len(columns), bins), held


def _split(tree: Tree, node: int, g: np.ndarray, h: np.ndarray, columns: list[int], s: Settings) -> bool:
    """Split ``node`` where the gain is largest (the first of equals), give values to it or its children; False for a leaf."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    tree.value[node] = -s.step * total_g / (total_h + s.l2)
    gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - total_g**2 / (total_h + s.l2)
    least = max(s.min_child_weight, 1e-6)  # no child without rows
    gain[(left_h < least) | (right_h < least)] = 0
    best = int(gain.argmax()) if gain.size else 0
    if not gain.size or gain.flat[best] <= 1e-9:
        return False
    column, cut = divmod(best, gain.shape[1])
    tree.feature[node], tree.cut[node] = columns[column], cut
    for child, cg, ch in ((2 * node, left_g, left_h), (2 * node + 1, right_g, right_h)):
        tree.value[child] = -s.step * cg[column, cut] / (ch[column, cut] + s.l2)
    return True


def fit(rows: DataFrame, features: list[str], rounds: int = 350, patience: int = 25, seed: int = 42, **settings) -> Fitted:
    """Boosted trees on rows with ``label`` (above 0: 1) and ``is_val``; ends when ``patience`` rounds brought no better loss.

    Missing feature values are the lowest. Without validation rows all rounds are kept, with a null-like loss (NaN); without
    training rows of both labels there is nothing to learn, which is a ValueError. Ties of gain go to the first feature and
    the lowest cut. Other columns only take part in the draw of rows.
    """
    s = Settings(**settings)
    n, attacks = rows.where(~F.col("is_val")).agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if not 0 < attacks < n:
        raise ValueError("training rows must hold both labels")
    base = float(np.log(attacks / (n - attacks)))
    cuts = _cuts(rows.where(~F.col("is_val")), features, s.max_bins)
    bins = 1 + max(len(c) for c in cuts)
    table = materialize(_binned(rows, features, cuts, base), "boosting")
    rng, width = np.random.default_rng(seed), len(features)
    taken = max(1, int(s.column_share * width))
    trees: list[Tree] = []
    losses: list[float] = []
    recent: list[Tree] = []

    def best() -> int:
        return int(np.argmin(losses)) if not np.isnan(losses).any() else len(losses) - 1

    for k in range(rounds + 1):  # the last pass only measures
        tree, nodes = Tree(s.max_depth), [1]
        columns = sorted(rng.choice(width, taken, replace=False).tolist())
        for depth in range(s.max_depth):
            (g, h), (loss, held) = _sums(table, width, bins, recent, tree, nodes, columns, seed * 1_000_003 + k, s.row_share)
            if depth == 0 and k:
                losses.append(float(loss / held) if held else float("nan"))
            if k == rounds or (depth == 0 and k and k - 1 - best() >= patience):
                break
            split = [node for i, node in enumerate(nodes) if _split(tree, node, g[i], h[i], columns, s)]
            nodes = [child for node in split for child in (2 * node, 2 * node + 1)]
            if not nodes:
                break
        if len(losses) < k or k == rounds or (k and k - 1 - best() >= patience):
            break
        trees.append(tree)
        recent = [*recent, tree]
        if len(recent) == STORE_EVERY:
            table, recent = materialize(_advanced(table, width, recent), "boosting"), []
    last = best()
    for tree in trees[: last + 1]:  # from numbers of bins to values
        for node in np.flatnonzero(tree.feature >= 0):
            tree.cut[node] = cuts[tree.feature[node]][int(tree.cut[node])]
    return Fitted(Booster(list(features), base, trees[: last + 1]), last, losses[last], losses)


def _advanced(table: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    def add(batches):
        for batch in batches:
            margin = _with_trees(batch, _matrix(batch, width), trees)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return table.mapInArrow(add, table.schema)
