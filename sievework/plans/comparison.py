"""Train, time and score every model with and without resampling."""

from __future__ import annotations

import time
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.models.registry import ModelSpec, Problem, default_registry, gaussian_spec, tree_spec
from sievework.operators import auc, evaluate, ranking, scale, smote
from sievework.plans import search
from sievework.session import materialize

SCENARIOS = ["none", "smote_k3"]
# Runs of a comparison that are under way at a time.
PARALLEL_RUNS = 6
# Training rows from which one run fills the executors, whose memory several runs would have to share.
MANY_ROWS = 100_000

# The two remarks of the final table, and the recall from which a class counts as found.
MISSED_REMARK = "Gagal deteksi minoritas (Accuracy Paradox)"
FOUND_REMARK = "Mampu deteksi minoritas"
FOUND_RECALL = 0.5

RESULT_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("smote", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "accuracy",
            "precision_w",
            "recall_w",
            "f1",
            "roc_auc",
            "train_seconds",
            "predict_seconds",
        )
    ]
)


@dataclass(frozen=True)
class Evaluation:
    """One run: a one-row metrics table, confusion matrix, class report and predictions."""

    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    predictions: DataFrame


def evaluate_model(
    spec: ModelSpec, train: DataFrame, test: DataFrame, problem: Problem, scenario: str = "none"
) -> Evaluation:
    """Fit, predict and score. Predictions are written once and read by every table."""
    start = time.perf_counter()
    model = spec.fit(train, problem)
    train_seconds = time.perf_counter() - start

    start = time.perf_counter()
    predictions = materialize(model.predict(test), "predictions")
    predict_seconds = time.perf_counter() - start

    counts = materialize(
        evaluate.confusion_counts(predictions, problem.label, "prediction"), "confusion"
    )
    row = evaluate.weighted_from_counts(counts).first()
    scores = {c: f"score_{c}" for c in problem.classes}
    area = auc.roc_auc_ovr(predictions, problem.label, scores).first()["roc_auc"]
    values = (
        spec.name,
        scenario,
        row["accuracy"],
        row["precision_w"],
        row["recall_w"],
        row["f1"],
        area,
        train_seconds,
        predict_seconds,
    )
    metrics = train.sparkSession.createDataFrame([values], RESULT_SCHEMA)
    return Evaluation(
        evaluate.round_metrics(metrics),
        evaluate.dense_confusion(counts),
        evaluate.report_from_counts(counts),
        predictions,
    )


def compare_models(
    train: DataFrame,
    test: DataFrame,
    problem: Problem,
    registry: Sequence[ModelSpec] | None = None,
    smote_k: int = 3,
    parallelism: int = PARALLEL_RUNS,
) -> DataFrame:
    """All models x {none, SMOTE}, ranked by F1.

    Scaling is fitted on the training rows; resampling comes after scaling. Each of the prepared
    training tables is written once and shared by all models. ``parallelism`` runs are under way at a time (beyond
    ``MANY_ROWS`` training rows one), so the seconds of a run hold what the others leave it. A run that fails has no metrics and a warning; the others
    go on, and only if all fail does the first error rise.
    """
    registry = list(default_registry() if registry is None else registry)
    features = list(problem.features)
    kept = [problem.key, problem.label, *features]
    fit = scale.fit_scaler(train, features)
    plain = {False: train.select(*kept), True: scale.apply_scaler(train.select(*kept), fit)}
    tests = {False: test.select(*kept), True: scale.apply_scaler(test.select(*kept), fit)}
    spark = train.sparkSession
    todo: list[tuple[ModelSpec, DataFrame, DataFrame, str]] = []
    for scenario in SCENARIOS:
        for scaled in (False, True):
            specs = [s for s in registry if s.use_scaling == scaled]
            if not specs:
                continue
            rows_in = plain[scaled]
            if scenario != "none":
                balanced = smote.smote(rows_in, features, problem.label, problem.key, smote_k)
                # Synthetic rows get keys below the originals' so that every key stays unique.
                rows_in = _with_keys(balanced, problem)
            prepared_train = materialize(rows_in, "train")
            prepared_test = materialize(tests[scaled], "test")
            todo += [(spec, prepared_train, prepared_test, scenario) for spec in specs]
    most = max((rows_in.count() for _, rows_in, _, _ in todo), default=0)
    rows = run_side_by_side(spark, todo, problem, parallelism if most <= MANY_ROWS else 1)
    return ranking.rank_models(spark.createDataFrame(rows, RESULT_SCHEMA))


def run_side_by_side(
    spark: SparkSession, runs: Sequence[tuple[ModelSpec, DataFrame, DataFrame, str]], problem: Problem, parallelism: int
) -> list[tuple]:
    """The metrics of every run (spec, train, test, scenario), in the order given.

    Each run submits its jobs from a thread of its own, which inherits the caller's job group and tags and names a
    scheduler pool, so that under fair scheduling no run waits for all of another.
    """

    def one(spec: ModelSpec, train: DataFrame, test: DataFrame, scenario: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{spec.name} {scenario}")
        return tuple(evaluate_model(spec, train, test, problem, scenario).metrics.first())

    blank = (None,) * (len(RESULT_SCHEMA) - 2)
    found, errors = [], []
    with ThreadPoolExecutor(parallelism) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), *run) for run in runs]
        for (spec, _, _, scenario), future in zip(runs, waiting):
            try:
                found.append(future.result())
            except Exception as error:  # noqa: BLE001
                errors.append(error)
                warnings.warn(f"{spec.name} ({scenario}) failed: {str(error)[:300]}", stacklevel=2)
                found.append((spec.name, scenario, *blank))
    if errors and len(errors) == len(runs):
        raise errors[0]
    return found


def _with_keys(balanced: DataFrame, problem: Problem) -> DataFrame:
    """Number synthetic rows -1, -2, .. per class, interleaved over classes."""
    own = -(F.col("number") * F.lit(problem.n_classes) + F.col(problem.label).cast("long") + 1)
    return balanced.withColumn(problem.key, F.coalesce(problem.key, own)).drop("number")


@dataclass(frozen=True)
class FinalModels:
    """The two-model table, its per-class detail and the search behind the second model."""

    table: DataFrame
    detail: DataFrame
    cv: DataFrame
    best: dict[str, Any]


def _remark(report: DataFrame) -> str:
    """Whether every class but the largest is found, by its recall."""
    rows = sorted(report.collect(), key=lambda r: -r["support"])[1:]
    return FOUND_REMARK if all(r["recall"] >= FOUND_RECALL for r in rows if r["support"]) else MISSED_REMARK


def final_models(
    train: DataFrame,
    test: DataFrame,
    problem: Problem,
    grid: Mapping[str, Sequence[Any]] = search.DT_GRID,
    folds: int = 5,
    smote_k: int = 3,
) -> FinalModels:
    """Baseline naive Bayes, and the best tree of a leak-free search refitted on all rows."""
    features, label, key = list(problem.features), problem.label, problem.key
    train = materialize(train.select(key, label, *features), "train")
    test = materialize(test.select(key, label, *features), "test")
    prepared = search.prepare_folds(train, features, label, key, folds, smote_k)
    cv = materialize(search.search_tree(prepared, features, label, grid), "cv")
    chosen = search.best_candidate(cv).first()["candidate_id"]
    best = search.candidates(grid)[chosen]

    def fit_best(rows: DataFrame, p: Problem):
        return search.refit_tree(rows, features, label, key, p.n_classes, best, smote_k)

    runs = [
        evaluate_model(gaussian_spec(), train, test, problem, "none"),
        evaluate_model(ModelSpec("Decision Tree", fit_best), train, test, problem, f"smote_k{smote_k}"),
    ]
    results = ranking.union_all(*[r.metrics for r in runs])
    picks = [
        ("Naive Bayes", "none", "Tidak", f"Baseline - {_remark(runs[0].report)}"),
        ("Decision Tree", f"smote_k{smote_k}", "Ya", f"Model Terbaik - {_remark(runs[1].report)}"),
    ]
    details = [
        r.report.withColumn("model", F.lit(name)) for r, name in zip(runs, ("Naive Bayes", "Decision Tree"))
    ]
    return FinalModels(
        ranking.final_comparison(results, picks),
        evaluate.round_metrics(ranking.union_all(*details)),
        cv,
        best,
    )


@dataclass(frozen=True)
class Experiment:
    """One row per model, the classes of each, and the parameters each was given."""

    table: DataFrame
    detail: DataFrame
    chosen: dict[str, dict[str, Any]]


def _experiment(runs: Mapping[str, Evaluation], chosen: dict[str, dict[str, Any]]) -> Experiment:
    details = [r.report.withColumn("model", F.lit(name)) for name, r in runs.items()]
    return Experiment(
        ranking.rank_models(ranking.union_all(*[r.metrics for r in runs.values()])),
        evaluate.round_metrics(ranking.union_all(*details)),
        chosen,
    )


def experiment_plain(train: DataFrame, test: DataFrame, problem: Problem) -> Experiment:
    """Naive Bayes against the decision tree, both as they come, on the training rows as they are."""
    specs = [gaussian_spec(), tree_spec()]
    runs = {s.name: evaluate_model(s, train, test, problem, "none") for s in specs}
    return _experiment(runs, {name: {} for name in runs})


def tuned_gaussian(
    train: DataFrame,
    prepared: search.Folds,
    problem: Problem,
    smoothings: Sequence[float] = tuple(search.NB_GRID["var_smoothing"]),
) -> tuple[ModelSpec, float]:
    """Naive Bayes with the smoothing that wins the search over ``prepared`` folds."""
    cv = search.search_gnb(prepared, problem.features, problem.label, smoothings)
    best = smoothings[search.best_candidate(cv).first()["candidate_id"]]
    return gaussian_spec(best), best


def experiment_tuned(
    train: DataFrame,
    test: DataFrame,
    problem: Problem,
    tree_grid: Mapping[str, Sequence[Any]] = search.DT_GRID,
    folds: int = 5,
    smote_k: int = 3,
) -> Experiment:
    """Both models with the settings that win a search on resampled folds, refitted on resampled rows."""
    features, label, key = list(problem.features), problem.label, problem.key
    prepared = search.prepare_folds(train, features, label, key, folds, smote_k)
    gaussian, smoothing = tuned_gaussian(train, prepared, problem)
    cv = materialize(search.search_tree(prepared, features, label, tree_grid), "cv")
    best = search.candidates(tree_grid)[search.best_candidate(cv).first()["candidate_id"]]

    def fit_best(rows: DataFrame, p: Problem):
        return search.refit_tree(rows, features, label, key, p.n_classes, best, smote_k)

    balanced = smote.materialized_smote(train, features, label, key, k=smote_k)
    scenario = f"smote_k{smote_k}"
    runs = {
        gaussian.name: evaluate_model(gaussian, balanced, test, problem, scenario),
        "Decision Tree": evaluate_model(ModelSpec("Decision Tree", fit_best), train, test, problem, scenario),
    }
    return _experiment(runs, {gaussian.name: {"var_smoothing": smoothing}, "Decision Tree": best})
