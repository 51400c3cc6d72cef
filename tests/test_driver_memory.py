"""Joins whose sides Spark misjudges: what is broadcast stays bounded whatever the table's size."""

import re

import pytest

from sievework.models import trees
from sievework.operators import smote

X = ["a", "b"]


def _rows(spark):
    sizes = {0: 300, 1: 40, 2: 25}
    rows = [(1000 * c + i, c, float(i % 37), float(i * i % 53) + c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, a double, b double")


@pytest.mark.parametrize("few", [0, smote.FEW_BASES])
def test_draws_are_never_broadcast(spark, monkeypatch, few):
    """The draws are as many as the synthetic rows, though a running query takes them for as small as their chunks."""
    monkeypatch.setattr(smote, "FEW_BASES", few)
    found = smote.smote(_rows(spark), X, "label", "id", 3)
    assert len(found.collect()) == 900
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if re.search(r"Join \[.*_base#", line)]
    assert len(joins) == 1 and "BuildLeft" not in joins[0]
    assert ("SortMergeJoin" in joins[0]) == (few == 0)


def test_both_ways_give_the_same_synthetic_rows(spark, monkeypatch):
    found = []
    for few in (0, smote.FEW_BASES):
        monkeypatch.setattr(smote, "FEW_BASES", few)
        found.append(sorted(map(str, smote.smote(_rows(spark), X, "label", "id", 3).collect())))
    assert found[0] == found[1] and len(found[0]) == 900


def test_both_ways_down_grow_the_same_tree(spark, monkeypatch):
    found = []
    for few in (0, trees.FEW_SPLITS):
        monkeypatch.setattr(trees, "FEW_SPLITS", few)
        nodes = trees.grow(_rows(spark), X, "label", 3, max_depth=6).nodes
        found.append(sorted(map(str, nodes.collect())))
    assert found[0] == found[1] and len(found[0]) > 20
