"""Random forests of many rows: one grouped count of binned rows, then every tree in a task of its own.

Rows with equal bins and class are one cell with a count, so a tree costs what its cells do, not its rows. A row that is
drawn Poisson(1) times makes a cell of n rows be drawn Poisson(n) times, so trees are grown on all rows. Finished
trees stay in the shared folder: the driver never holds them, and rows are scored by their cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.functions.portable import SEED
from sievework.models import trees as level_trees
from sievework.operators.skew import salted_join
from sievework.session import materialize

#: Cells (bins, class) that come to the driver and to each task at most.
MAX_CELLS = 500_000
MAX_DEPTH = 30
#: Trees that are walked in a task together, and cells they walk at most about.
TREES_A_TASK = 5
CELLS_A_TASK = 100_000

_TREES = "tree int, split binary, bin binary, left binary, counts binary"


def best_splits(
    node: np.ndarray, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, total: np.ndarray, tried: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none gains) and bin of every node's best Gini split. ``node`` and ``label`` number the rows' nodes and
    classes, ``total`` has the weights by (node, class) and ``tried`` the features each node may use."""
    many, classes = total.shape
    rows = total.sum(axis=1)
    best = (total**2).sum(axis=1) / rows * (1 + 1e-12) + 1e-9
    feature, at = np.full(many, -1), np.zeros(many, np.int64)
    for f in range(bins.shape[1]):
        used = np.flatnonzero(tried[node, f])
        if not len(used):
            continue
        key = node[used] * (level_trees.BINS + 1) + bins[used, f]
        order = np.argsort(key, kind="stable")
        used, key = used[order], key[order]
        sums = np.zeros((len(used) + 1, classes))
        sums[np.arange(1, len(used) + 1), label[used]] = weight[used]
        sums = sums.cumsum(axis=0)
        end = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
        own = node[used[end]]
        first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        # What stands before a node's first row.
        before = sums[np.append(0, end[first[1:] - 1] + 1)]
        left = sums[end + 1] - np.repeat(before, np.diff(np.append(first, len(own))), axis=0)
        right = total[own] - left
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        allowed = (n_left > 0) & (n_right > 0)
        score = (left**2).sum(axis=1) / np.maximum(n_left, 1) + (right**2).sum(axis=1) / np.maximum(n_right, 1)
        score = np.where(allowed, score, -1.0)
        top = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(own)))))
        nodes, where = np.unique(own[hit], return_index=True)
        better = top > best[nodes]
        nodes, where = nodes[better], hit[where[better]]
        best[nodes], feature[nodes], at[nodes] = score[where], f, key[end[where]] % (level_trees.BINS + 1)
    return feature, at


def grow_tree(bins: np.ndarray, label: np.ndarray, count: np.ndarray, n_classes: int, n_try: int, seed: Sequence[int]) -> tuple:
    """split (feature, -1 for a leaf), bin, place of the left child and class counts by node, of one tree on a bootstrap
    sample. Rows above the bin go right; the right child follows the left one."""
    rng = np.random.default_rng(list(seed))
    weight = rng.poisson(count).astype(np.float64)
    if not weight.any():
        weight = count.astype(np.float64)
    row = np.flatnonzero(weight)
    node = np.zeros(len(row), np.int64)
    split, cut, left, counts = [], [], [], []
    placed, many = 1, 1
    for depth in range(MAX_DEPTH + 1):
        total = np.bincount(node * n_classes + label[row], weight[row], many * n_classes).reshape(many, n_classes)
        feature, at = np.full(many, -1), np.zeros(many, np.int64)
        if depth < MAX_DEPTH:
            width = bins.shape[1]
            tried = rng.random((many, width)).argsort(axis=1).argsort(axis=1) < n_try
            open_ = (total > 0).sum(axis=1) > 1
            inside = open_[node]
            feature, at = best_splits(node[inside], bins[row[inside]], label[row[inside]], weight[row[inside]], total, tried)
        inner = feature >= 0
        child = placed + 2 * (np.cumsum(inner) - 1)
        split.append(feature)
        cut.append(at)
        left.append(np.where(inner, child, 0))
        counts.append(total)
        many = 2 * int(inner.sum())
        if not many:
            break
        stays = inner[node]
        row, node = row[stays], node[stays]
        over = bins[row, feature[node]] > at[node]
        node = child[node] + over - placed
        placed += many
    return (
        np.concatenate(split).astype(np.int16),
        np.concatenate(cut).astype(np.int16),
        np.concatenate(left).astype(np.int32),
        np.concatenate(counts),
    )


def walk(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """Class shares of the leaf that each row of bins falls into."""
    split, cut, left, counts = tree
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (inner := split[at] >= 0).any():
        over = bins[row, np.maximum(split[at], 0)] > cut[at]
        at = np.where(inner, left[at] + over, at)
    found = counts[at]
    return found / found.sum(axis=1, keepdims=True)


def _bins(features: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """The bins of a row: the number of cuts below each value. A missing value raises."""

    @F.pandas_udf("array<int>")
    def run(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]
        if any(np.isnan(v).any() for v in values):
            raise ValueError("a row has a feature that is missing or not a number")
        found = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, values)]
        return pd.Series(list(np.column_stack(found).astype(np.int32)))

    return run(*[F.col(f).cast("double") for f in features])


@dataclass(frozen=True)
class Forest:
    """Trees as a table of flat arrays, and the cuts of the bins they are grown on."""

    trees: DataFrame
    n_trees: int
    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    n_classes: int

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``score_<class>``, the mean share over all trees; each different cell is walked once."""
        n_classes, width = self.n_classes, len(self.features)
        binned = materialize(df.withColumn("_bins", _bins(self.features, self.cuts)), "forest-rows")
        cells = materialize(binned.select("_bins").distinct(), "forest-asked")
        slices = max(1, ceil(cells.count() / CELLS_A_TASK))
        groups = ceil(self.n_trees / TREES_A_TASK)

        def every(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        asked = cells.withColumn("_slice", F.pmod(F.xxhash64("_bins"), F.lit(slices)).cast("int")).withColumn("_group", every(groups))
        known = self.trees.withColumn("_group", F.floor(F.col("tree") / TREES_A_TASK).cast("int")).withColumn("_slice", every(slices))

        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a):
                return pd.DataFrame({"_bins": [], "_group": [], "_shares": []})
            bins = np.stack(a["_bins"].to_numpy()).reshape(len(a), width)
            found = np.zeros((len(a), n_classes))
            for t in b.sort_values("tree").itertuples():
                arrays = [np.frombuffer(x, d) for x, d in ((t.split, np.int16), (t.bin, np.int16), (t.left, np.int32), (t.counts, np.float64))]
                found += walk((*arrays[:3], arrays[3].reshape(-1, n_classes)), bins)
            return pd.DataFrame({"_bins": a["_bins"], "_group": key[0], "_shares": list(found)})

        on = ["_group", "_slice"]
        parts = asked.groupBy(*on).cogroup(known.groupBy(*on)).applyInPandas(run, "_bins array<int>, _group int, _shares array<double>")
        # Groups are added up in order, so that a score does not depend on which task ends first.
        lists = parts.groupBy("_bins").agg(F.array_sort(F.collect_list(F.struct("_group", "_shares"))).alias("_parts"))

        def mean(c: int) -> Column:
            return F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["_shares"][c]) / F.lit(float(self.n_trees))

        shares = materialize(lists.select("_bins", *[mean(c).alias(f"_s{c}") for c in range(n_classes)]), "forest-shares")
        scored = salted_join(binned, shares, ["_bins"], F.xxhash64(*df.columns))
        columns = [F.col(f"_s{c}") for c in range(n_classes)]
        best = S.argmax_first(columns, [float(c) for c in range(n_classes)])
        return scored.select(*df.columns, best.alias("prediction"), *[c.alias(f"score_{i}") for i, c in enumerate(columns)])


def fit_forest(train: DataFrame, features: Sequence[str], label: str, n_classes: int, trees: int = 100) -> Forest | None:
    """A forest of Gini trees on bootstrap samples of all rows, the root of the feature number (rounded up) tried at each
    split, depth 30. None if the rows have more than ``MAX_CELLS`` cells. A missing feature raises."""
    features = list(features)
    rows = train.select(F.lit(0).alias("part"), F.col(label).cast("int").alias("label"), *features)
    cuts = level_trees._cuts(rows, features)
    if 0 not in cuts:
        raise ValueError("no rows to fit on")
    both = rows.withColumns({"n": F.lit(1).cast("long"), "v": F.lit(0).cast("long")})
    columns = [F.col("bins")[i].alias(f"b{i}") for i in range(len(features))]
    cells = materialize(level_trees._binned(both, features, cuts).select("label", "n", *columns), "forest-cells")
    if cells.count() > MAX_CELLS:
        return None
    # Sorted, so that a tree does not depend on the order the cells came in.
    taken = cells.toPandas().sort_values(["label", *[f"b{i}" for i in range(len(features))]], ignore_index=True)
    bins = taken[[f"b{i}" for i in range(len(features))]].to_numpy(dtype=np.int16)
    if taken["label"].isna().any() or not taken["label"].between(0, n_classes - 1).all():
        raise ValueError(f"labels are not all in 0..{n_classes - 1}")
    labels, count = taken["label"].to_numpy(dtype=np.int64), taken["n"].to_numpy(dtype=np.int64)
    n_try = ceil(sqrt(len(features)))

    def grow(batches):
        for batch in batches:
            for tree in batch["id"].tolist():
                found = grow_tree(bins, labels, count, n_classes, n_try, (SEED, tree))
                yield pd.DataFrame([(tree, *[x.tobytes() for x in found])], columns=["tree", "split", "bin", "left", "counts"])

    grown = train.sparkSession.range(0, trees, 1, trees).mapInPandas(grow, _TREES)
    return Forest(materialize(grown, "forest-trees"), trees, tuple(features), tuple(map(tuple, cuts[0])), n_classes)
