"""Decision trees grown level by level, any number of them in the same jobs.

Feature values become bins once. A level is one grouped count per (tree, node, feature, bin, class); the best
split of every node of every tree is then a small table, and joining it moves the rows one level down.
Rows that are only to be counted at the nodes (left-out rows of a search) walk along with weight 0, so limits
on depth and split size are read off the finished node table and nothing is ever walked tree by tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.functions.portable import SEED, uniform
from sievework.session import materialize

#: Bins of a feature, cut at evenly spaced quantiles of the training rows.
BINS = 128
#: Accuracy of the quantile sketch; below so many rows the cuts are exact order statistics.
ACCURACY = 10_000
#: Depth that stands in for "no limit".
MAX_DEPTH = 30
#: Training rows a tree is grown on at most, drawn by hash beyond it; twice as many nodes is a tree's bound.
FIT_ROWS = 500_000
#: Splits of a level that are sent to all tasks at most; files of split tables are far smaller than the rows in memory.
FEW_SPLITS = 20_000


@dataclass(frozen=True)
class Shape:
    """How a tree chooses splits. ``n_try`` features with a possible split are drawn at each node (None: all)."""

    criterion: str = "gini"
    min_leaf: int = 1
    n_try: int | None = None


@dataclass(frozen=True)
class Grown:
    """Node table (tree, node, depth, t, f, b, and v where rows were counted) and the cuts of each part. ``t`` and ``v``
    count training and counted rows by class, ``f`` and ``b`` are the split (null for a leaf); the children of node k are 2k+1 and
    2k+2, and tree number is part * shapes + shape."""

    nodes: DataFrame
    cuts: dict[int, list[list[float]]]
    shapes: tuple[Shape, ...]
    n_classes: int


def _cuts(train: DataFrame, features: Sequence[str]) -> dict[int, list[list[float]]]:
    probs = [i / BINS for i in range(1, BINS)]
    aggs = [F.percentile_approx(f, probs, ACCURACY).alias(f"q{i}") for i, f in enumerate(features)]
    unknown = reduce(Column.__or__, [F.col(f).isNull() | F.isnan(f) for f in features])
    found = {}
    for r in train.groupBy("part").agg(*aggs, F.count_if(unknown).alias("unknown")).collect():
        if r["unknown"]:
            raise ValueError(f"{r['unknown']} training rows have a feature that is missing or not a number")
        found[r["part"]] = [sorted(set(r[f"q{i}"])) for i in range(len(features))]
    return found


def _binned(rows: DataFrame, features: Sequence[str], cuts: dict[int, list[list[float]]]) -> DataFrame:
    """(part, label, bins, n, v): rows with equal bins added up. A bin is the number of cuts below the value."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            found = np.zeros((batch.num_rows, width), np.int32)
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                for i in range(width):
                    values = batch.column(4 + i).to_numpy(zero_copy_only=False)[at]
                    found[at, i] = np.searchsorted(cuts[p][i], values, side="left")
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            bins = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], bins], ["part", "label", "n", "v", "bins"])

    schema = "part int, label int, n long, v long, bins array<int>"
    binned = rows.select("part", "label", "n", "v", *[F.col(f).cast("double") for f in features]).mapInArrow(run, schema)
    return binned.groupBy("part", "label", "bins").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def _level_sql(shapes: Sequence[Shape], n_classes: int, last: bool) -> str:
    """The best split of every node of {hist}, as text: one parse instead of hundreds of expression calls a level.

    A side's purity is its squared counts over their sum, or its negative entropy times its rows; sums of
    logarithms are rounded so that equal splits tie. Ties go to the smaller feature and then the smaller bin.
    Nodes of one class are leaves, and all are on the last level.
    """
    classes = range(n_classes)

    def each(form: str, by: str = ", ") -> str:
        return by.join(form.format(c=c) for c in classes)

    def own(values: Sequence) -> str:
        text = ", ".join("NULL" if v is None else repr(v) for v in values)
        return f"element_at(array({text}), tree % {len(shapes)} + 1)"

    def squares(x: str, n: str) -> str:
        return "(" + each(f"CAST({x} * {x} AS DOUBLE)", " + ") + f") / {n}"

    def logs(x: str, n: str) -> str:
        return each(f"CASE WHEN {x} > 0 THEN {x} * ln(CAST({x} AS DOUBLE)) ELSE 0D END", " + ") + f" - {n} * ln(CAST({n} AS DOUBLE))"

    gini = f"{own([s.criterion for s in shapes])} = 'gini'"
    least, tries = own([s.min_leaf for s in shapes]), own([s.n_try for s in shapes])
    order = "best IS NULL, f"
    if any(s.n_try is not None for s in shapes):
        order = f"best IS NULL, md5(concat_ws(':', '{SEED}', 'feature', tree, node, f)), f"
    tried = f"best IS NOT NULL AND ({tries} IS NULL OR place <= {tries})" if "md5" in order else "best IS NOT NULL"
    split = "false" if last else f"greatest({each('t{c}')}) < {each('t{c}', ' + ')}"
    return f"""
WITH sides AS (
  SELECT *, {each("sum(h{c}) OVER (PARTITION BY tree, node, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS l{c}")},
    {each("sum(h{c}) OVER (PARTITION BY tree, node, f) AS t{c}")} FROM {{hist}}),
sized AS (SELECT *, {each("t{c} - l{c} AS r{c}")}, {each("l{c}", " + ")} AS nl, {each("t{c} - l{c}", " + ")} AS nr FROM sides),
scored AS (
  SELECT *, CASE WHEN nl >= {least} AND nr >= {least} THEN
    CASE WHEN {gini} THEN {squares("l{c}", "nl")} + {squares("r{c}", "nr")}
      ELSE bround({logs("l{c}", "nl")} + {logs("r{c}", "nr")}, 7) END END AS score FROM sized),
by_feature AS (
  SELECT tree, node, f, max(CASE WHEN score IS NOT NULL THEN struct(score, -b AS b) END) AS best,
    {each("first(t{c}) AS t{c}")} FROM scored GROUP BY tree, node, f),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {order}) AS place FROM by_feature),
nodes AS (
  SELECT tree, node, max(CASE WHEN {tried} THEN struct(best.score AS score, -f AS f, best.b AS b) END) AS pick,
    {each("first(t{c}) AS t{c}")} FROM placed GROUP BY tree, node)
SELECT tree, node, array({each("t{c}")}) AS t,
  CASE WHEN {split} THEN -pick.f END AS f, CASE WHEN {split} THEN -pick.b END AS b FROM nodes"""


def _level(active: DataFrame, shapes: Sequence[Shape], n_classes: int, last: bool) -> DataFrame:
    """(tree, node, t, f, b) of every node that training rows stand on, from one grouped count."""
    counts = ", ".join(f"sum(CASE WHEN label = {c} THEN n ELSE 0 END) AS h{c}" for c in range(n_classes))
    spark = active.sparkSession
    spread = "(SELECT tree, node, label, n, posexplode(bins) AS (f, b) FROM {active} WHERE n > 0)"
    text = f"SELECT tree, node, f, b, {counts} FROM {spread} GROUP BY tree, node, f, b"
    # A node's counts are few, and all windows and groups that follow keep its rows together.
    hist = spark.sql(text, active=active).repartition("tree", "node")
    return spark.sql(_level_sql(shapes, n_classes, last), hist=hist)


def _counted(walked: Sequence[DataFrame], n_classes: int) -> DataFrame:
    """(tree, node, v): the counted rows that came by each node, by class."""
    rows = reduce(DataFrame.unionAll, [w.where("v > 0").select("tree", "node", "label", "v") for w in walked])
    per_class = [F.sum(F.when(F.col("label") == c, F.col("v")).otherwise(0)) for c in range(n_classes)]
    return rows.groupBy("tree", "node").agg(F.array(*per_class).alias("v"))


_DOWN = """
SELECT /*+ %s(splits) */ tree, node * 2 + 1 + CASE WHEN get(bins, f) > b THEN 1 ELSE 0 END AS node, label, n, v, bins
FROM {active} JOIN (SELECT tree, node, f, b FROM {level} WHERE f IS NOT NULL) AS splits USING (tree, node)"""


def grow(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    n_classes: int,
    shapes: Sequence[Shape] = (Shape(),),
    part: str | None = None,
    counted: DataFrame | None = None,
    counted_part: str | None = None,
    max_depth: int = MAX_DEPTH,
    fit_rows: int = FIT_ROWS,
) -> Grown:
    """Trees of every shape on the training rows of every part (numbers from 0; one part without the column).

    ``counted`` rows are only counted at the nodes of their part's trees. Beyond ``fit_rows`` rows a part is
    drawn by the hash of a row's values. A missing feature value raises.
    """
    number = F.lit(0) if part is None else F.col(part).cast("int")
    target = F.col(label).cast("int").alias("label")
    rows = train.select(number.alias("part"), target, *features)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    many = {r["part"]: r["rows"] for r in sizes.collect() if r["rows"] > fit_rows}
    for p, n in many.items():
        rows = rows.where((F.col("part") != p) | (uniform("fit", "label", *features) < fit_rows / n))
    cuts = _cuts(rows, features)
    both = rows.withColumns({"n": F.lit(1).cast("long"), "v": F.lit(0).cast("long")})
    if counted is not None:
        own = F.lit(0) if counted_part is None else F.col(counted_part).cast("int")
        extra = counted.select(own.alias("part"), target, *features)
        both = both.unionByName(extra.withColumns({"n": F.lit(0).cast("long"), "v": F.lit(1).cast("long")}))
    trees = F.explode(F.sequence(F.col("part") * len(shapes), (F.col("part") + 1) * len(shapes) - 1)).alias("tree")
    binned = _binned(both, features, cuts).select(trees, F.lit(0).cast("long").alias("node"), "label", "n", "v", "bins")
    active = materialize(binned, "tree-rows")
    levels, walked = [], [active]
    for depth in range(max_depth + 1):
        seen = Observation()
        found = _level(active, shapes, n_classes, depth == max_depth)
        found = found.observe(seen, F.count_if(F.col("f").isNotNull()).alias("splits"))
        level = materialize(found, f"tree-level-{depth}")
        levels.append(level.withColumn("depth", F.lit(depth)))
        if not seen.get["splits"]:
            break
        way = "BROADCAST" if seen.get["splits"] <= FEW_SPLITS else "MERGE"
        down = train.sparkSession.sql(_DOWN % way, active=active, level=level)
        # Written at every level: plans stay alike, so their code is compiled once, and lineage stays short.
        active = materialize(down, "tree-rows")
        walked.append(active)
    nodes = reduce(DataFrame.unionAll, levels)
    if counted is not None:
        none = F.array(*[F.lit(0).cast("long")] * n_classes)
        seen_by = _counted(walked, n_classes)
        nodes = materialize(nodes.join(seen_by, ["tree", "node"], "left").withColumn("v", F.coalesce("v", none)), "tree-nodes")
    return Grown(nodes, cuts, tuple(shapes), n_classes)


def _row_total(column: str) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)


def majority(counts: Column, n_classes: int) -> Column:
    """The class with most rows, the lowest on ties."""
    columns = [counts[c] for c in range(n_classes)]
    return S.argmax_first(columns, list(range(n_classes)))


def with_limits(nodes: DataFrame, limits: DataFrame, on: Sequence[str]) -> DataFrame:
    """Nodes that are the leaves once a tree stops at ``max_depth`` and does not split nodes below ``min_split`` rows.

    Greedy growth makes the smaller tree a cut-off larger one. A node is reached if its parent was large enough
    to split, for the rows of the nodes above can only be more.
    """
    sized = nodes.withColumn("rows", _row_total("t"))
    above = sized.select("tree", F.col("node").alias("up"), F.col("rows").alias("up_rows"))
    up = F.floor((F.col("node") - 1) / 2).cast("long")
    joined = sized.withColumn("up", up).join(above, ["tree", "up"], "left").drop("up").join(limits, list(on))
    depth, least = F.coalesce("max_depth", F.lit(MAX_DEPTH)), F.col("min_split")
    reached = (F.col("depth") <= depth) & (F.col("up_rows").isNull() | (F.col("up_rows") >= least))
    stopped = (F.col("depth") == depth) | (F.col("rows") < least) | F.col("f").isNull()
    return joined.where(reached & stopped)


def candidate_counts(grown: Grown, limits: DataFrame) -> DataFrame:
    """(candidate_id, fold, actual, predicted, n) of the counted rows for ``limits`` (candidate_id, shape, max_depth,
    min_split)."""
    size = len(grown.shapes)
    nodes = grown.nodes.withColumns({"fold": F.floor(F.col("tree") / size).cast("int"), "shape": F.col("tree") % size})
    leaves = with_limits(nodes, limits, ["shape"])
    guess = majority(F.col("t"), grown.n_classes).alias("predicted")
    per_class = [F.sum(F.col("v")[c]).alias(f"v{c}") for c in range(grown.n_classes)]
    wide = leaves.groupBy("candidate_id", "fold", guess).agg(*per_class)
    cells = F.array(*[F.struct(F.lit(float(c)).alias("actual"), F.col(f"v{c}").alias("n")) for c in range(grown.n_classes)])
    long = wide.select("candidate_id", "fold", F.col("predicted").cast("double").alias("predicted"), F.inline(cells))
    return long.where("n > 0").select("candidate_id", "fold", "actual", "predicted", "n")


@dataclass(frozen=True)
class TreeModel:
    """One tree as flat arrays, walked for a whole batch of rows at once."""

    features: tuple[str, ...]
    n_classes: int
    split: np.ndarray  # feature number, -1 for a leaf
    cut: np.ndarray
    left: np.ndarray  # place of the left child; the right one follows it
    shares: np.ndarray

    def leaves(self, values: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(values), np.int64), np.arange(len(values))
        while (inner := self.split[at] >= 0).any():
            over = values[row, np.maximum(self.split[at], 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + over, at)
        return at

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and one ``score_<class>`` per class: the shares of the leaf's training rows."""

        @F.pandas_udf("array<double>")
        def walk(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            return pd.Series(list(self.shares[self.leaves(values)]))

        taken = [F.col(f).cast("double") for f in self.features]
        scored = df.withColumn("_shares", walk(*taken))
        columns = [F.col("_shares")[c] for c in range(self.n_classes)]
        best = S.argmax_first(columns, [float(c) for c in range(self.n_classes)])
        scores = [c.alias(f"score_{i}") for i, c in enumerate(columns)]
        return scored.select(*df.columns, best.alias("prediction"), *scores)


def fit_tree(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    n_classes: int,
    criterion: str = "gini",
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: int | None = None,
    min_samples_split: int = 2,
    fit_rows: int = FIT_ROWS,
) -> TreeModel:
    """One tree with all limits. Its nodes, twice ``fit_rows`` at most, come to the driver as one table."""
    depth = MAX_DEPTH if max_depth is None else min(max_depth, MAX_DEPTH)
    shape = Shape(criterion, min_samples_leaf, max_features)
    grown = grow(train, features, label, n_classes, [shape], max_depth=depth, fit_rows=fit_rows)
    limits = train.sparkSession.createDataFrame([(0, depth, min_samples_split)], "tree int, max_depth int, min_split int")
    ends = with_limits(grown.nodes, limits, ["tree"]).select("node", F.lit(True).alias("is_leaf"))
    kept = grown.nodes.join(ends, "node", "left").select("node", "t", "f", "b", "is_leaf").toPandas().sort_values("node")
    node = kept["node"].to_numpy()
    leaf = kept["is_leaf"].notna().to_numpy()
    counts = np.stack(kept["t"].to_numpy()).astype(np.float64)
    f = kept["f"].fillna(-1).to_numpy().astype(np.int64)
    b = kept["b"].fillna(0).to_numpy().astype(np.int64)
    cut = np.array([grown.cuts[0][i][k] if i >= 0 else 0.0 for i, k in zip(f.tolist(), b.tolist())])
    left = np.searchsorted(node, 2 * node + 1)
    shares = counts / counts.sum(axis=1, keepdims=True)
    return TreeModel(tuple(features), n_classes, np.where(leaf, -1, f), cut, left, shares)
