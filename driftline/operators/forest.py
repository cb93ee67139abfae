"""Random forests over counted cells: bins are learned once, trees are grown level by level for all at once.

A tree sees a row only through the bins of its features. Rows that agree in all bins and in the label are
therefore one *cell* with a count, and a bootstrap that draws each row Poisson(1) times draws a cell of ``n`` rows
Poisson(``n``) times: the same law, at the cost of the distinct cells. Rows that are all different are cells of one.

Cells are dealt to blocks by a hash. For each level a task adds up the drawn rows of one block per open node,
candidate feature and bin; the sums of all blocks, and the best cut of each node, are aggregates and windows. Only
one row per open node comes to the driver. Draws depend on the seed, the tree and the block, candidate
features on the seed, the tree and the place in the tree: for given bins neither on partitions nor on the order of rows.

As in ``pyspark.ml``: Gini impurity, 32 bins, the square root of the features (rounded up) as candidates of a
node, a categorical value is a feature of its own, and the score is the mean share of class 1 in the leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, inf, isqrt

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.catalog import FeatureSchema
from driftline.session import materialize

BINS = 32
#: Cut of a leaf, above every bin.
NO_CUT = 255
#: Relative error of the quantiles that bins are cut at: a tenth of a bin.
QUANTILE_ERROR = 0.1 / BINS
#: Cells of a block, which one task holds (a byte per feature) and draws for tree by tree; small tables have the least
#: number of blocks, so that forests do not depend on the number of cores.
BLOCK_CELLS = 50_000
LEAST_BLOCKS = 32
SUMS = "node int, slot int, bin int, w long, wy long"


def cut_points(table: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """At most ``BINS - 1`` cuts per column, each opening a bin: values at even steps of the rows.

    Frequent values take several steps at once; the steps they leave free go to the other values, so that a column
    of few values is cut at each of them, and rare values beside a very frequent one are told apart.
    """
    cuts: dict[str, set[float]] = {c: set() for c in columns}
    steps = [i / BINS for i in range(1, BINS)]
    still = list(columns)
    while still:
        rest = table.select(*[F.when(~F.col(c).isin(list(cuts[c])), F.col(c)).cast("double").alias(c) for c in still])
        found = dict(zip(still, rest.approxQuantile(still, steps, QUANTILE_ERROR)))
        for c in still:
            values, room = sorted(set(found[c])), BINS - 1 - len(cuts[c])
            if len(values) > room:
                values = [values[(2 * i + 1) * len(values) // (2 * room)] for i in range(room)]
            cuts[c].update(values)
        still = [c for c in still if found[c] and len(cuts[c]) < BINS - 1]
    return {c: sorted(v) for c, v in cuts.items()}


@dataclass(frozen=True)
class Encoding:
    """How rows become bytes: one bin number per numeric column, one 0 or 1 per categorical value seen in training."""

    cuts: dict[str, list[float]]
    values: dict[str, list[str]]

    @staticmethod
    def learn(train: DataFrame, schema: FeatureSchema) -> Encoding:
        kinds = {c: sorted(r[0] for r in train.select(c).distinct().collect() if r[0] is not None) for c in schema.categorical}
        cuts = cut_points(train, schema.numeric)
        if not all(cuts.values()):
            raise ValueError("a forest needs at least one training row")
        return Encoding(cuts, kinds)

    @property
    def width(self) -> int:
        return len(self.cuts) + sum(map(len, self.values.values()))

    def names(self) -> list[str]:
        return [f"_f{i}" for i in range(self.width)]

    def encode(self, table: DataFrame) -> DataFrame:
        """``table`` with the feature columns ``names()``; a missing number is an error, an unseen category is all 0."""
        binned = [f"_bin_{c}" for c in self.cuts]
        splits = [[-inf, *cuts, inf] for cuts in self.cuts.values()]
        wide = Bucketizer(splitsArray=splits, inputCols=list(self.cuts), outputCols=binned).transform(table)
        hits = [F.coalesce(F.col(c) == v, F.lit(False)) for c, values in self.values.items() for v in values]
        features = [v.cast("byte").alias(name) for name, v in zip(self.names(), [*map(F.col, binned), *hits])]
        return wide.select(*table.columns, *features)


@dataclass(frozen=True)
class Cells:
    """Training rows counted by feature bytes and label ``y``, as ``n``, with their ``block``."""

    table: DataFrame
    encoding: Encoding
    share: float

    @staticmethod
    def count(train: DataFrame, schema: FeatureSchema) -> Cells:
        return Cells.of(train, Encoding.learn(train, schema))

    @staticmethod
    def of(train: DataFrame, encoding: Encoding) -> Cells:
        names = encoding.names()
        counted = encoding.encode(train).groupBy(*names, "y").agg(F.count(F.lit(1)).alias("n"))
        table = materialize(counted.withColumn("key", F.xxhash64(*names, "y")), "cells")
        size = table.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
        blocks = max(ceil(size[0] / BLOCK_CELLS), LEAST_BLOCKS)
        dealt = table.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).repartition(blocks, "block")
        return Cells(dealt, encoding, size[2] / size[1])


@dataclass
class Trees:
    """Nodes of all trees; the roots come first. A leaf is its own left child, and no bin lies above its cut."""

    seed: int
    left: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    score: np.ndarray
    tree: np.ndarray
    path: np.ndarray
    roots: int
    depth: int = 0

    @staticmethod
    def stumps(seed: int, trees: int, share: float) -> Trees:
        ids, ones = np.arange(trees), np.ones(trees, np.int64)
        return Trees(seed, ids, 0 * ids, np.full(trees, NO_CUT, np.uint8), np.full(trees, share), ids, ones, trees)

    def candidates(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """Features a node may be cut by, drawn by seed, tree and place in the tree."""
        size = isqrt(width - 1) + 1
        drawn = [np.random.default_rng([self.seed, 1, self.tree[i], self.path[i]]).permutation(width)[:size] for i in nodes]
        return np.array(drawn)

    def split(self, best: pd.DataFrame) -> np.ndarray:
        """Cut nodes as chosen; returns the new nodes that hold both classes."""
        best = best.sort_values("node")
        at = best["node"].to_numpy()
        count = len(self.left)
        kids = count + np.arange(2 * len(at))
        w = np.stack([best["wl"], best["w"] - best["wl"]], 1).ravel()
        wy = np.stack([best["wyl"], best["wy"] - best["wyl"]], 1).ravel()
        self.left = np.concatenate([self.left, kids])
        self.left[at] = kids[::2]
        self.feature = np.concatenate([self.feature, 0 * kids])
        self.feature[at] = best["feature"]
        self.cut = np.concatenate([self.cut, np.full(len(kids), NO_CUT, np.uint8)])
        self.cut[at] = best["bin"]
        self.score = np.concatenate([self.score, wy / w])
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[at], 2)])
        self.path = np.concatenate([self.path, np.stack([2 * self.path[at], 2 * self.path[at] + 1], 1).ravel()])
        self.depth += 1
        return kids[(wy > 0) & (wy < w)]


def _sums(trees: Trees, nodes: np.ndarray, features: np.ndarray, names: list[str]):
    """Function of one block: drawn rows ``w``, and those of class 1, per open node, candidate feature and bin."""
    rank = np.full(len(trees.left), -1)
    rank[nodes] = np.arange(len(nodes))
    of_tree = trees.tree[nodes]
    growing = np.unique(of_tree)
    lowest = {t: int(np.flatnonzero(of_tree == t)[0]) for t in growing}
    highest = {t: int(np.flatnonzero(of_tree == t)[-1]) + 1 for t in growing}
    slots, seed, depth = features.shape[1], trees.seed, trees.depth
    left, feature, cut = trees.left, trees.feature, trees.cut
    # Rows that reached a finished leaf are left behind on the way down.
    onward = (rank >= 0) | (left != np.arange(len(left)))

    def block(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["key", *names, "y"])
        number = int(cells["block"].iloc[0])
        rows = cells[names].to_numpy(np.uint8)
        n, y = cells["n"].to_numpy(np.int64), cells["y"].to_numpy(np.int64)
        flat, base = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
        parts = []
        for t in growing:
            drawn = np.random.default_rng([seed, 0, int(t), number]).poisson(n)
            used = np.flatnonzero(drawn)
            node = np.full(len(used), t)
            for _ in range(depth):
                node = left[node] + (flat[base[used] + feature[node]] > cut[node])
                on = onward[node]
                used, node = used[on], node[on]
            if not len(used):
                continue
            at, w, start = rank[node], drawn[used].astype(float), base[used]
            wy, first, size = w * y[used], lowest[t], (highest[t] - lowest[t]) * BINS
            for slot in range(slots):
                code = (at - first) * BINS + flat[start + features[at, slot]]
                both = np.bincount(code, w, size), np.bincount(code, wy, size)
                hit = np.flatnonzero(both[0])
                parts.append((nodes[first + hit // BINS], np.full(len(hit), slot), hit % BINS, *(b[hit].astype(np.int64) for b in both)))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 5
        return pd.DataFrame(dict(zip(("node", "slot", "bin", "w", "wy"), columns)))

    return block


def _gini(w: Column, wy: Column) -> Column:
    return 2.0 * wy * (w - wy) / w


def best_cuts(sums: DataFrame) -> DataFrame:
    """Per node its drawn rows, and the candidate and bin whose cut lowers the impurity most (null: none does)."""
    whole = Window.partitionBy("node", "slot")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = sums.groupBy("node", "slot", "bin").agg(F.sum("w").alias("_w"), F.sum("wy").alias("_wy"))
    sides = added.select(
        "node", "slot", "bin", F.sum("_w").over(upto).alias("wl"), F.sum("_wy").over(upto).alias("wyl"),
        F.sum("_w").over(whole).alias("w"), F.sum("_wy").over(whole).alias("wy"),
    )
    w, wy, wl, wyl = map(F.col, ("w", "wy", "wl", "wyl"))
    gain = F.when(wl < w, _gini(w, wy) - _gini(wl, wyl) - _gini(w - wl, wy - wyl))
    cut = F.when(gain > 1e-9 * w, F.struct(gain, -F.col("slot"), -F.col("bin"), "wl", "wyl"))
    best = sides.groupBy("node").agg(F.max("w").alias("w"), F.max("wy").alias("wy"), F.max(cut).alias("_cut"))
    numbers = [-F.col("_cut.col2"), -F.col("_cut.col3"), F.col("_cut.wl"), F.col("_cut.wyl")]
    return best.select("node", "w", "wy", *[c.alias(name) for c, name in zip(numbers, ("slot", "bin", "wl", "wyl"))])


def grow(cells: Cells, seed: int, trees: int, max_depth: int) -> Trees:
    """Trees of one forest: a job per level, for all trees."""
    names = cells.encoding.names()
    forest = Trees.stumps(seed, trees, cells.share)
    nodes = np.arange(trees)
    for level in range(max_depth):
        if not len(nodes):
            break
        features = forest.candidates(nodes, len(names))
        sums = cells.table.groupBy("block").applyInPandas(_sums(forest, nodes, features, names), SUMS)
        best = best_cuts(sums).toPandas()
        if not level:
            forest.score[best["node"]] = best["wy"] / best["w"]
        best = best.dropna().astype(np.int64)
        slot = best["slot"].to_numpy()
        nodes = forest.split(best.assign(feature=features[np.searchsorted(nodes, best["node"]), slot]))
    return forest


def score(encoding: Encoding, forests: dict[str, Trees], table: DataFrame) -> DataFrame:
    """``table`` with one column per forest, the score of each row.

    Rows stay in their partition, where equal rows are brought together, so that a batch scores its different rows only.
    """
    names, columns = encoding.names(), list(forests)
    parts = [(f.left, f.feature, f.cut, f.score, f.roots, f.depth) for f in forests.values()]

    @F.pandas_udf(", ".join(f"s{i} double" for i in range(len(columns))))
    def mean(*features: pd.Series) -> pd.DataFrame:
        rows = np.stack([f.to_numpy(np.uint8) for f in features], 1)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        flat, base = rows[new].ravel(), np.arange(new.sum()) * rows.shape[1]
        of_row, out = np.cumsum(new) - 1, {}
        for i, (left, feature, cut, leaf, roots, depth) in enumerate(parts):
            total = np.zeros(len(base))
            for root in range(roots):
                node = np.full(len(base), root)
                for _ in range(depth):
                    node = left[node] + (flat[base + feature[node]] > cut[node])
                total += leaf[node]
            out[f"s{i}"] = (total / roots)[of_row]
        return pd.DataFrame(out)

    together = encoding.encode(table).sortWithinPartitions(F.xxhash64(*names))
    scored = together.select(*table.columns, mean(*names).alias("_scores"))
    return scored.select(*table.columns, *[F.col(f"_scores.s{i}").alias(c) for i, c in enumerate(columns)])
