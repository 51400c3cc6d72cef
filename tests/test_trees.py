"""Level-wise trees against growing them node by node, and the limits read off them."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.models import trees

X = ["x1", "x2"]


def rows_of(n, seed, part=0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        a, b = float(draw.randrange(12)), draw.random() * 5
        label = int(a > 5) + int(b > 2.5 and draw.random() < 0.8)
        out.append((i, part, label if draw.random() < 0.9 else draw.randrange(3), a, b))
    return out


def naive(rows, shape, depth):
    """{node: (class counts, feature, cut)} by plain recursion over the same cuts."""
    cuts = []
    for f in (3, 4):
        values = sorted(r[f] for r in rows)
        n = len(values)
        cuts.append(sorted({values[max(0, math.ceil(i / trees.BINS * n) - 1)] for i in range(1, trees.BINS)}))
    nodes = {}

    def purity(counts):
        n = sum(counts)
        if shape.criterion == "gini":
            return sum(c * c for c in counts) / n
        return sum(c * math.log(c) for c in counts if c) - n * math.log(n)

    def count(some):
        return [sum(1 for r in some if r[2] == c) for c in range(3)]

    def visit(node, some, level):
        own, best = count(some), None
        if level < depth and max(own) < len(some):
            for f in range(2):
                for b, cut in enumerate(cuts[f]):
                    left, right = [r for r in some if r[3 + f] <= cut], [r for r in some if r[3 + f] > cut]
                    if min(len(left), len(right)) >= max(1, shape.min_leaf):
                        score = purity(count(left)) + purity(count(right))
                        score = score if shape.criterion == "gini" else round(score, 7)
                        if best is None or score > best[0]:
                            best = (score, f, b, left, right)
        nodes[node] = (own, best and best[1], best and cuts[best[1]][best[2]])
        if best:
            visit(2 * node + 1, best[3], level + 1)
            visit(2 * node + 2, best[4], level + 1)

    visit(0, rows, 0)
    return nodes


def test_all_trees_of_all_parts_are_grown_together(spark):
    parts = [rows_of(150, 1, 0), rows_of(90, 2, 1)]
    table = spark.createDataFrame([r for p in parts for r in p], "id long, part int, label int, x1 double, x2 double")
    shapes = [trees.Shape(), trees.Shape("entropy", 4)]
    grown = trees.grow(table.repartition(5), X, "label", 3, shapes, "part", max_depth=5)
    found = {}
    for r in grown.nodes.collect():
        cut = None if r["f"] is None else grown.cuts[r["tree"] // 2][r["f"]][r["b"]]
        found.setdefault(r["tree"], {})[r["node"]] = (list(r["t"]), r["f"], cut)
    for tree in range(4):
        assert found[tree] == naive(parts[tree // 2], shapes[tree % 2], 5), tree


def test_limits_read_off_a_full_tree(spark):
    """A tree with limits has the leaves that growing with these limits gives, and counts rows there."""
    rows = rows_of(200, 3)
    table = spark.createDataFrame(rows, "id long, part int, label int, x1 double, x2 double")
    grown = trees.grow(table, X, "label", 3, [trees.Shape(min_leaf=2)], counted=table)
    assert grown.nodes.where("t <> v").count() == 0
    limits = spark.createDataFrame([(0, 0, 3, 2), (1, 0, None, 30), (2, 0, 0, 2)], "candidate_id int, shape int, max_depth int, min_split int")
    counts = {}
    for r in trees.candidate_counts(grown, limits).collect():
        counts.setdefault(r["candidate_id"], {})[(r["actual"], r["predicted"])] = r["n"]
    for i, depth, split in ((0, 3, 2), (1, None, 30), (2, 0, 2)):
        model = trees.fit_tree(table, X, "label", 3, "gini", depth, 2, None, split)
        out = model.predict(table).groupBy(F.col("label").cast("double"), "prediction").count().collect()
        assert counts[i] == {(r[0], r[1]): r[2] for r in out}


def test_drawn_features_and_small_inputs(spark):
    table = spark.createDataFrame(rows_of(60, 4), "id long, part int, label int, x1 double, x2 double")
    model = trees.fit_tree(table, X, "label", 3, max_features=1)
    again = trees.fit_tree(table.repartition(7), X, "label", 3, max_features=1)
    assert np.array_equal(model.cut, again.cut) and np.array_equal(model.split, again.split)
    hit = model.predict(table).where("prediction = label").count()
    assert hit >= 57  # grown until nothing can be split any more
    one = trees.fit_tree(table.where("label = 1"), X, "label", 3)
    assert {r["prediction"] for r in one.predict(table).collect()} == {1.0}
    with pytest.raises(ValueError, match="missing"):
        trees.fit_tree(table.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), X, "label", 3)


def test_fit_rows_bound_the_tree(spark):
    table = spark.createDataFrame(rows_of(3000, 5), "id long, part int, label int, x1 double, x2 double")
    grown = trees.grow(table, X, "label", 3, max_depth=1, fit_rows=500)
    taken = sum(grown.nodes.where("node = 0").first()["t"])
    assert 350 < taken < 650


@pytest.mark.parametrize("listed", [None, 4])
def test_neighbours_of_all_folds_from_one_search(spark, listed):
    """Lists that a fold leaves too short are searched for again; all are those of searching each fold."""
    from sievework.operators import neighbors, smote

    draw = random.Random(9)
    rows = [(i, i % 4 % 3, float(draw.randrange(4)), float(draw.randrange(5)), i // 3 % 5) for i in range(160)]
    rows += [(1000 + i, 9, float(i), 0.0, i % 5) for i in range(6)]
    table = spark.createDataFrame(rows, "id long, label int, x1 double, x2 double, fold int").repartition(3)
    found = neighbors.knn_leaving_out(table, X, "id", 3, ["label"], "fold", 5, listed=listed)
    copies = smote.fold_training_sets(table, "fold", 5)
    want = neighbors.knn_within_group(copies, X, "id", 3, ["left_out", "label"])
    shown = lambda df: sorted((r["left_out"], r["id"], [s["key"] for s in r["neighbors"]]) for r in df.collect())
    assert shown(found) == shown(want)
