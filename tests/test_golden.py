"""Published numbers, re-derived."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.operators import evaluate, ranking, sampling
from sievework.plans import search

NAMES = ["Normal", "Stunted", "Severely Stunted"]

# Published confusion matrices (rows = actual) and accuracy, precision, recall, F1.
MATRICES = {
    "nb": ([[245, 0, 0], [18, 0, 0], [3, 0, 0]], (0.9211, 0.8483, 0.9211, 0.8832)),
    "dt": ([[237, 8, 0], [8, 9, 1], [0, 2, 1]], (0.9286, 0.9287, 0.9286, 0.9284)),
    "nb_tuned": ([[101, 84, 60], [2, 13, 3], [0, 1, 2]], (0.4361, 0.9125, 0.4361, 0.5505)),
    "dt_tuned": ([[236, 9, 0], [7, 11, 0], [0, 1, 2]], (0.9361, 0.9412, 0.9361, 0.938)),
}

# Published comparison: model, scenario, accuracy, precision, recall, F1.
RESULTS = [
    ("XGBoost", "none", 0.9586, 0.9562, 0.9586, 0.9551),
    ("Random Forest", "smote_k3", 0.9549, 0.955, 0.9549, 0.9546),
    ("Gradient Boosting", "smote_k3", 0.9549, 0.9529, 0.9549, 0.9533),
    ("Gradient Boosting", "none", 0.9511, 0.95, 0.9511, 0.9501),
    ("KNN", "smote_k3", 0.9436, 0.9618, 0.9436, 0.9493),
    ("Random Forest", "none", 0.9549, 0.9502, 0.9549, 0.9484),
    ("Decision Tree", "smote_k3", 0.9474, 0.9503, 0.9474, 0.9483),
    ("XGBoost", "smote_k3", 0.9436, 0.9423, 0.9436, 0.9425),
    ("KNN", "none", 0.9474, 0.9401, 0.9474, 0.9359),
    ("Decision Tree", "none", 0.9286, 0.9287, 0.9286, 0.9284),
    ("SVM", "smote_k3", 0.9135, 0.9535, 0.9135, 0.9265),
    ("Logistic Regression", "none", 0.9211, 0.8851, 0.9211, 0.8898),
    ("Naive Bayes", "none", 0.9211, 0.8483, 0.9211, 0.8832),
    ("SVM", "none", 0.9211, 0.8483, 0.9211, 0.8832),
    ("Logistic Regression", "smote_k3", 0.8346, 0.9259, 0.8346, 0.8713),
    ("Naive Bayes", "smote_k3", 0.4361, 0.9125, 0.4361, 0.5505),
]


@pytest.fixture(scope="module")
def predictions(spark):
    """One row per counted test row of the published matrices."""
    cells = [
        (run, a, p, n)
        for run, (matrix, _) in MATRICES.items()
        for a, row in enumerate(matrix)
        for p, n in enumerate(row)
        if n
    ]
    counted = spark.createDataFrame(cells, "run string, y int, p int, n int")
    return counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("run", "y", "p")


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        RESULTS, "model string, smote string, accuracy double, precision_w double, recall_w double, f1 double"
    )


def test_metrics_of_the_published_matrices(predictions):
    counts = evaluate.confusion_counts(predictions, "y", "p", ["run"])
    found = evaluate.round_metrics(evaluate.weighted_from_counts(counts, ["run"]))
    for row in found.collect():
        expected = MATRICES[row["run"]][1]
        assert (row["accuracy"], row["precision_w"], row["recall_w"], row["f1"]) == expected


def test_dense_matrix_keeps_empty_classes(predictions):
    matrix = evaluate.confusion_matrix(predictions, "y", "p", ["run"])
    cells = {(r["run"], r["actual"], r["predicted"]): r["n"] for r in matrix.collect()}
    assert len(cells) == 4 * 9
    for run, (rows, _) in MATRICES.items():
        assert [[cells[(run, a, p)] for p in range(3)] for a in range(3)] == rows


def test_class_detail(predictions):
    report = evaluate.round_metrics(evaluate.classification_report(predictions, "y", "p", ["run"]))
    got = {(r["run"], r["class"]): (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    assert got[("nb", 0)] == (0.9211, 1.0, 0.9589, 245)
    assert got[("nb", 1)] == (0.0, 0.0, 0.0, 18)
    assert got[("dt_tuned", 0)] == (0.9712, 0.9633, 0.9672, 245)
    assert got[("dt_tuned", 1)] == (0.5238, 0.6111, 0.5641, 18)
    assert got[("dt_tuned", 2)] == (1.0, 0.6667, 0.8, 3)


def test_accuracy_paradox(predictions):
    found = evaluate.accuracy_paradox(predictions, "y", "p", ["run"])
    lost = {(r["run"], r["class"]) for r in found.where("paradox").collect()}
    assert lost == {("nb", 1), ("nb", 2)}


def test_ranking_and_effect(results):
    ranked = ranking.rank_models(results).collect()
    assert [(r["model"], r["smote"]) for r in ranked[:2]] == [
        ("XGBoost", "none"),
        ("Random Forest", "smote_k3"),
    ]
    effect = ranking.resampling_effect(results)
    gains = [(r["model"], r["delta"]) for r in ranking.top_gains(effect).collect()]
    assert gains == [("SVM", 0.0433), ("Decision Tree", 0.0199), ("KNN", 0.0134)]
    counted = ranking.effect_counts(effect).first()
    assert (counted["n_improved"], counted["n_worsened"]) == (5, 3)
    best = {r["scope"]: r["model"] for r in ranking.best_per_scenario(results).collect()}
    assert best == {"none": "XGBoost", "smote_k3": "Random Forest", "overall": "XGBoost"}


def test_published_split_sizes():
    sizes = {0: 1226, 1: 88, 2: 15}
    quota = sampling.test_quotas(sizes, 0.2)
    assert quota == {0: 245, 1: 18, 2: 3}
    assert {c: sizes[c] - quota[c] for c in sizes} == {0: 981, 1: 70, 2: 12}


def test_published_grid_sizes():
    assert search.grid_size(search.NB_GRID) == 8
    assert search.grid_size(search.DT_GRID) == len(search.candidates(search.DT_GRID)) == 576
    assert search.max_features("sqrt", 3) == search.max_features("log2", 3) == 1


def test_cv_spread_is_the_population_one(spark):
    """Folds of two candidates with equal means share rank 1, the next one gets rank 3."""
    rows = [(c, f, s) for c, ss in enumerate([(0.9, 0.8), (0.8, 0.9), (0.5, 0.6)]) for f, s in enumerate(ss)]
    scores = spark.createDataFrame(rows, "candidate_id int, fold int, score double")
    cv = {r["candidate_id"]: r for r in search.cv_results(scores, 2).collect()}
    assert [cv[i]["rank"] for i in range(3)] == [1, 1, 3]
    assert cv[0]["std"] == pytest.approx(0.05)
