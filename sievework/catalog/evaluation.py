"""Evaluation tables over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.base import duck, duck_report, pred, query, r6, runs
from sievework.operators import auc, evaluate

_PRED = duck("pred", then=duck_report("pred", "label", "prediction", ""))
_RUNS = duck("runs", then=duck_report("runs", "y", "p", "model, smote"))
_BY = ["model", "smote"]


@query(
    "accuracy",
    _RUNS + "SELECT model, smote, round_even(accuracy, 6) AS accuracy FROM metrics",
)
def accuracy(spark, sf):
    found = evaluate.accuracy(runs(spark, sf), "y", "p", _BY)
    return found.select(*_BY, r6("accuracy", "accuracy"))


@query(
    "weighted_prf",
    _RUNS
    + """SELECT model, smote, round_even(precision_w, 6) AS precision_w, round_even(recall_w, 6) AS recall_w,
round_even(f1, 6) AS f1 FROM metrics""",
)
def weighted_prf(spark, sf):
    found = evaluate.weighted_prf(runs(spark, sf), "y", "p", _BY)
    return evaluate.round_metrics(found, 6)


_GRID = """, grid AS (SELECT a.class AS actual, p.class AS predicted FROM cls a, cls p)
"""


@query(
    "confusion_matrix",
    _PRED
    + _GRID
    + """SELECT g.actual, g.predicted, coalesce(n, 0) AS n FROM grid g LEFT JOIN cm
ON cm.actual = g.actual AND cm.predicted = g.predicted""",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(pred(spark, sf), "label", "prediction")


@query(
    "confusion_matrix_wide",
    _RUNS
    + """SELECT model, smote, CASE actual WHEN 0 THEN 'Normal' WHEN 1 THEN 'Stunted' ELSE 'Severely Stunted' END AS actual,
CAST(sum(CASE WHEN predicted = 0 THEN n ELSE 0 END) AS BIGINT) AS pred_normal,
CAST(sum(CASE WHEN predicted = 1 THEN n ELSE 0 END) AS BIGINT) AS pred_stunted,
CAST(sum(CASE WHEN predicted = 2 THEN n ELSE 0 END) AS BIGINT) AS pred_severely_stunted FROM cm GROUP BY model, smote, actual""",
)
def confusion_matrix_wide(spark, sf):
    matrix = evaluate.confusion_matrix(runs(spark, sf), "y", "p", _BY)
    names = {0: "Normal", 1: "Stunted", 2: "Severely Stunted"}
    return evaluate.confusion_wide(matrix, [0, 1, 2], _BY, names)


@query(
    "classification_report",
    _PRED
    + """SELECT class, round_even("precision", 6) AS "precision", round_even(recall, 6) AS recall,
round_even(f1, 6) AS f1, support FROM report""",
)
def classification_report(spark, sf):
    found = evaluate.classification_report(pred(spark, sf), "label", "prediction")
    return evaluate.round_metrics(found, 6)


@query(
    "report_averages",
    _RUNS
    + """SELECT model, smote, 'accuracy' AS average, round_even(accuracy, 6) AS "precision", round_even(accuracy, 6) AS recall,
round_even(accuracy, 6) AS f1, (SELECT count(*) FROM labelled) AS support FROM metrics
UNION ALL SELECT model, smote, 'weighted avg', round_even(precision_w, 6), round_even(recall_w, 6), round_even(f1, 6),
(SELECT count(*) FROM labelled) FROM metrics
UNION ALL SELECT model, smote, 'macro avg', round_even(avg("precision"), 6), round_even(avg(recall), 6), round_even(avg(f1), 6),
CAST(sum(support) AS BIGINT) FROM report GROUP BY model, smote""",
)
def report_averages(spark, sf):
    found = evaluate.report_averages(runs(spark, sf), "y", "p", _BY)
    return evaluate.round_metrics(found, 6)


def _scored(spark, sf):
    """Scores per class: high for the predicted class, with many equal scores among rows."""
    rows = pred(spark, sf)
    lift = F.floor(F.col("u") * 20) / F.lit(20.0)
    cells = {
        f"score_{c}": F.when(F.col("prediction") == c, lift + F.lit(0.5)).otherwise(lift)
        for c in range(4)
    }
    return rows.withColumns(cells)


_AUC = """s AS (SELECT c, CASE WHEN label = c THEN 1 ELSE 0 END AS pos,
 CASE WHEN prediction = c THEN floor(u * 20) / 20.0::DOUBLE + 0.5 ELSE floor(u * 20) / 20.0::DOUBLE END AS score
 FROM pred, range(4) AS t(c)),
g AS (SELECT c, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM s GROUP BY c, score),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY c ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round_even(avg(a), 6) AS roc_auc FROM (SELECT c, sum(pos * (below + neg / 2.0::DOUBLE))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)) AS a FROM b GROUP BY c)"""


@query("roc_auc_ovr", duck("pred", then=_AUC))
def roc_auc_ovr(spark, sf):
    found = auc.roc_auc_ovr(_scored(spark, sf), "label", {c: f"score_{c}" for c in range(4)})
    return found.select(r6("roc_auc", "roc_auc"))


@query(
    "trace_accuracy",
    _RUNS
    + """SELECT model, smote, CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS n_correct,
CAST(sum(n) AS BIGINT) AS n_total, round_even(sum(CASE WHEN actual = predicted THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS share
FROM cm GROUP BY model, smote""",
)
def trace_accuracy(spark, sf):
    counts = evaluate.confusion_counts(runs(spark, sf), "y", "p", _BY)
    found = evaluate.trace_accuracy(counts, _BY)
    return found.withColumn("share", F.bround("share", 6))


_MAJORITY = duck(
    "pred",
    then="majority AS (SELECT label, 2 AS guess FROM imb),"
    + duck_report("majority", "label", "guess", ""),
)


@query(
    "accuracy_paradox",
    _MAJORITY
    + """SELECT class, round_even(recall, 6) AS recall, round_even(accuracy, 6) AS accuracy,
recall = 0 AND support > 0 AND accuracy >= 0.7 AS paradox FROM report, metrics""",
)
def accuracy_paradox(spark, sf):
    """A guesser that always names the largest class: good accuracy, every other class lost."""
    guessed = pred(spark, sf).withColumn("guess", F.lit(2))
    found = evaluate.accuracy_paradox(guessed, "label", "guess", high=0.7)
    return found.withColumns({c: F.bround(c, 6) for c in ("recall", "accuracy")})


