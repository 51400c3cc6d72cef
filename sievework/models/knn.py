"""k-nearest-neighbour classifiers on the exact and, for many features, on the projected neighbour search."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import neighbors, projected_neighbors


def classify(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    classes: Sequence[Any],
    k: int = 5,
    proba: bool = False,
    cell_rows: int = neighbors.CELL_ROWS,
) -> DataFrame:
    """Test rows with the majority class of their k nearest training rows.

    Every neighbour has one vote and the smallest class wins a tie; ``score_<i>`` is the vote share.
    """
    known = train.select(F.col(label).alias("_label"), key, *features)
    lists = neighbors.neighbor_lists(known, test, features, key, k, (), ["_label"], cell_rows)
    voted = neighbors.attach_neighbors(test, lists, features, key)

    def votes_for(c: Any) -> Column:
        return F.size(F.filter("neighbors", lambda s: s["_label"] == F.lit(c)))

    votes = [votes_for(c) for c in classes]
    out = voted.withColumn("prediction", S.argmax_first(votes, classes))
    if proba:
        share = [F.try_divide(v.cast("double"), F.size("neighbors").cast("double")) for v in votes]
        out = out.withColumns({f"score_{i}": s for i, s in enumerate(share)})
    return out.drop("neighbors")


def classify_projected(
    train: DataFrame, test: DataFrame, vector: str, label: str, key: str, k: int = 5, **search: int
) -> DataFrame:
    """(key, prediction, votes) for every test row with a usable vector, by ``approx_neighbors``.

    Keys must be unique over both parts. Every neighbour has one vote and the smallest class wins a tie;
    neighbours without a label do not vote. ``search`` goes to the neighbour search.
    """
    found = projected_neighbors.approx_neighbors(train, test, vector, key, k, **search)
    known = train.select(F.col(key).alias("neighbor"), F.col(label).alias("_label")).where(F.col("_label").isNotNull())
    votes = found.select(key, "neighbor").join(known, "neighbor").groupBy(key, "_label").agg(F.count(F.lit(1)).alias("votes"))
    first = F.min(F.struct((-F.col("votes")).alias("v"), F.col("_label").alias("prediction"))).alias("best")
    best = votes.groupBy(key).agg(first)
    return best.select(key, "best.prediction", (-F.col("best.v")).alias("votes"))
