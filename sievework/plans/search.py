"""Leak-free grid search: resampling is done on the training part of each fold only.

All folds are prepared together: one column says which fold is left out, so splitting, resampling
and fitting are single jobs over all folds rather than a loop.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from math import floor, log2, sqrt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.functions import scalars as S
from sievework.functions.portable import SEED
from sievework.models import gnb, trees
from sievework.operators import evaluate, ranking, sampling, smote
from sievework.session import materialize

# The two published grids.
NB_GRID: dict[str, list] = {"var_smoothing": S.logspace(-12, -5, 8)}
DT_GRID: dict[str, list] = {
    "criterion": ["gini", "entropy"],
    "max_depth": [3, 5, 7, 10, 15, None],
    "max_features": [None, "sqrt", "log2"],
    "min_samples_leaf": [1, 2, 5, 10],
    "min_samples_split": [2, 5, 10, 20],
}


def candidates(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations; names in alphabetical order, the last one changing fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence[Any]]) -> DataFrame:
    """(candidate_id, params) with parameter values as text, NULL for None."""
    rows = [
        (i, {k: None if v is None else str(v) for k, v in c.items()})
        for i, c in enumerate(candidates(grid))
    ]
    return spark.createDataFrame(rows, "candidate_id int, params map<string,string>")


def grid_size(grid: Mapping[str, Sequence[Any]]) -> int:
    n = 1
    for values in grid.values():
        n *= len(values)
    return n


def fit_plan(folded: DataFrame, grid: Mapping[str, Sequence[Any]], k: int, fold: str = "fold") -> DataFrame:
    """(candidate_id, params, fold, n_train, n_valid): every fit a search is going to make."""
    sizes = folded.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n_valid"))
    total = sizes.agg(F.sum("n_valid")).scalar()
    with_train = sizes.withColumn("n_train", total - F.col("n_valid"))
    # Every fold row takes the position of a candidate apart into one position per parameter.
    names = sorted(grid)
    rows = with_train.withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.lit(grid_size(grid) - 1))))
    values, step = {}, grid_size(grid)
    for name in names:
        step //= len(grid[name])
        at = F.floor(F.col("candidate_id") / F.lit(step)).cast("int") % F.lit(len(grid[name]))
        values[name] = F.element_at(F.array(*[F.lit(v) for v in grid[name]]), at + 1)
    return rows.select(
        "candidate_id", *[v.alias(n) for n, v in values.items()], "fold", "n_train", "n_valid"
    )


def max_features(choice: str | int | None, n_features: int) -> int | None:
    """Number of features tried per split; ``sqrt`` and ``log2`` are rounded down, at least 1."""
    if choice is None or isinstance(choice, int):
        return choice
    return max(1, floor({"sqrt": sqrt, "log2": log2}[choice](n_features)))


def cv_results(scores: DataFrame, folds: int) -> DataFrame:
    """(candidate_id, split0.., mean, std, rank) from (candidate_id, fold, score).

    Mean and population std add the folds in a fixed order, so equal candidates get equal values.
    """
    splits = [f"split{f}" for f in range(folds)]
    wide = scores.groupBy("candidate_id").pivot("fold", list(range(folds))).agg(F.max("score"))
    wide = wide.withColumnsRenamed({str(f): f"split{f}" for f in range(folds)})
    total = sum((F.col(s) for s in splits[1:]), F.col(splits[0]))
    with_mean = wide.withColumn("mean", total / F.lit(float(folds)))
    gaps = [(F.col(s) - F.col("mean")) * (F.col(s) - F.col("mean")) for s in splits]
    spread = sum(gaps[1:], gaps[0])
    table = with_mean.withColumn("std", F.sqrt(spread / F.lit(float(folds))))
    return ranking.competition_rank(table, "mean")


def top_candidates(cv: DataFrame, n: int = 10) -> DataFrame:
    return cv.orderBy("rank", "candidate_id").limit(n)


def best_candidate(cv: DataFrame) -> DataFrame:
    """(candidate_id, mean) of rank 1; the first in grid order wins a tie."""
    least = F.min(F.struct("rank", "candidate_id", "mean"))
    return cv.agg(least.alias("b")).select(
        F.col("b.candidate_id").alias("candidate_id"), F.col("b.mean").alias("mean")
    )


def tuning_curve(cv: DataFrame, params: DataFrame, name: str) -> DataFrame:
    """(param, mean, rank, is_best) in parameter order; the smallest parameter of rank 1 is best."""
    value = F.col("params")[name].cast("double").alias(name)
    curve = cv.join(params.select("candidate_id", value), "candidate_id")
    top = Window.partitionBy("rank").orderBy(name)
    is_best = (F.col("rank") == 1) & (F.row_number().over(top) == 1)
    return curve.select(name, "mean", "rank", is_best.alias("is_best")).orderBy(name)


@dataclass(frozen=True)
class Folds:
    """Left-out rows by ``fold`` and balanced training rows by ``left_out``."""

    validation: DataFrame
    training: DataFrame
    n: int


def prepare_folds(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    folds: int = 5,
    smote_k: int | None = 3,
    seed: int = SEED,
) -> Folds:
    folded = sampling.stratified_kfold(
        train.select(key, label, *features), label, [key], folds, seed
    )
    folded = materialize(folded, "folds")
    if smote_k is None:
        training = smote.fold_training_sets(folded, "fold", folds)
    else:
        training = smote.smote_per_fold(folded, features, label, key, folds, smote_k, seed=seed)
    return Folds(folded, materialize(training, "fold-training"), folds)


def score_table(counts: DataFrame) -> DataFrame:
    """(candidate_id, fold, score): support-weighted F1.

    Rounded far below any real difference, so that candidates with the same predictions tie
    whatever order their classes were added up in.
    """
    scored = evaluate.weighted_from_counts(counts, ["candidate_id", "fold"])
    return scored.select("candidate_id", "fold", F.bround("f1", 12).alias("score"))


def search_gnb(
    prepared: Folds,
    features: Sequence[str],
    label: str,
    smoothings: Sequence[float] = tuple(NB_GRID["var_smoothing"]),
) -> DataFrame:
    """CV table of all smoothing candidates: one fit job and one scoring job over all folds."""
    fits = {p[0]: m for p, m in gnb.fit_parts(prepared.training, features, label, ["left_out"]).items()}
    predicted = gnb.predict_candidates(
        prepared.validation, fits, "fold", dict(enumerate(smoothings))
    )
    counts = evaluate.confusion_counts(predicted, label, "prediction", ["candidate_id", "fold"])
    return cv_results(score_table(counts), prepared.n)


# --- decision tree ------------------------------------------------------------------------


def search_tree(
    prepared: Folds,
    features: Sequence[str],
    label: str,
    grid: Mapping[str, Sequence[Any]] = DT_GRID,
    n_classes: int | None = None,
) -> DataFrame:
    """CV table of a decision-tree grid, with the share of the common fit and scoring time each candidate has.

    One full tree per fold and distinct (criterion, leaf size, feature number), all grown together level by level.
    Left-out rows walk along and are counted at every node, so candidates that differ in depth and split limits
    only are read off the node table. Labels are 0..n_classes-1 (by default up to the largest there is).
    """
    all_candidates = candidates(grid)
    shapes: dict[trees.Shape, int] = {}
    limits = []
    for i, c in enumerate(all_candidates):
        tries = max_features(c.get("max_features"), len(features))
        shape = trees.Shape(c.get("criterion", "gini"), c.get("min_samples_leaf", 1), tries)
        number = shapes.setdefault(shape, len(shapes))
        limits.append((i, number, c.get("max_depth"), c.get("min_samples_split", 2)))
    if n_classes is None:
        n_classes = int(prepared.validation.agg(F.max(label)).first()[0]) + 1
    deepest = max(trees.MAX_DEPTH if c.get("max_depth") is None else c["max_depth"] for c in all_candidates)
    begin = time.perf_counter()
    grown = trees.grow(
        prepared.training,
        features,
        label,
        n_classes,
        list(shapes),
        "left_out",
        prepared.validation,
        "fold",
        min(deepest, trees.MAX_DEPTH),
    )
    fitted = time.perf_counter()
    spark = prepared.training.sparkSession
    table = spark.createDataFrame(limits, "candidate_id int, shape int, max_depth int, min_split int")
    counts = materialize(trees.candidate_counts(grown, table), "tree-counts")
    cv = materialize(cv_results(score_table(counts), prepared.n), "cv")
    scored = time.perf_counter()
    # All fits share their jobs; every candidate is charged an equal part.
    parts = len(all_candidates) * prepared.n
    spent = {"mean_fit_seconds": (fitted - begin) / parts, "mean_score_seconds": (scored - fitted) / parts}
    none = {"std_fit_seconds": F.lit(0.0), "std_score_seconds": F.lit(0.0)}
    return cv.withColumns({k: F.lit(v) for k, v in spent.items()} | none)


def refit_tree(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    n_classes: int,
    params: Mapping[str, Any],
    smote_k: int = 3,
) -> trees.TreeModel:
    """The chosen tree, fitted on all training rows after resampling them."""
    balanced = smote.materialized_smote(train, features, label, key, k=smote_k)
    return trees.fit_tree(
        balanced,
        features,
        label,
        n_classes,
        params.get("criterion", "gini"),
        params.get("max_depth"),
        params.get("min_samples_leaf", 1),
        max_features(params.get("max_features"), len(features)),
        params.get("min_samples_split", 2),
    )


def refit_gnb(
    train: DataFrame, features: Sequence[str], label: str, key: str, smote_k: int = 3
) -> gnb.GaussianFit:
    """Naive Bayes on all training rows after resampling them; smoothing is applied on predicting."""
    return gnb.fit(smote.materialized_smote(train, features, label, key, k=smote_k), features, label)
