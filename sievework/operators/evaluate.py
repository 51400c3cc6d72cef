"""Evaluation tables from a label and a prediction column, for one run or many runs at once.

``by`` columns name the run (model, scenario, fold, candidate). Rows are first counted per
(run, label, prediction): a map-side combined aggregate whose size is runs x classes^2 however
many rows there are. Everything else works on that small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.functions import scalars as S


def confusion_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, actual, predicted, n) of the pairs that occur."""
    kind = df.schema[actual].dataType
    return df.groupBy(
        *by, F.col(actual).alias("actual"), F.col(predicted).cast(kind).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def _pair(actual: Column, predicted: Column) -> Column:
    """A map key for two labels that tells apart any texts, and NULL."""
    return F.to_json(F.array(actual.cast("string"), predicted.cast("string")))


def dense_confusion(
    counts: DataFrame, by: Sequence[str] = (), classes: Sequence[Any] | None = None
) -> DataFrame:
    """Fill in pairs that never occur with 0, over all labels and predictions seen."""
    kind = counts.schema["actual"].dataType
    pair = _pair(F.col("actual"), F.col("predicted"))
    per_run = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(pair, "n"))).alias("cells"),
        F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("seen"),
    )
    if classes is not None:
        per_run = per_run.withColumn("seen", F.array(*[F.lit(c).cast(kind) for c in classes]))

    def cell(a: Column, p: Column) -> Column:
        n = F.coalesce(F.col("cells")[_pair(a, p)], F.lit(0))
        return F.struct(a.alias("actual"), p.alias("predicted"), n.cast("long").alias("n"))

    grid = F.flatten(F.transform("seen", lambda a: F.transform("seen", lambda p: cell(a, p))))
    return per_run.select(*by, F.inline(grid))


def confusion_matrix(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: Sequence[str] = (),
    classes: Sequence[Any] | None = None,
) -> DataFrame:
    """Long matrix (by, actual, predicted, n), dense over all classes."""
    return dense_confusion(confusion_counts(df, actual, predicted, by), by, classes)


def confusion_wide(
    matrix: DataFrame, classes: Sequence[Any], by: Sequence[str] = (), names: Mapping[Any, str] | None = None
) -> DataFrame:
    """One row per actual class, one ``pred_<class>`` column per predicted class."""
    wide = matrix.groupBy(*by, "actual").pivot("predicted", list(classes)).agg(F.sum("n"))
    cells = [
        F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{_name_slug(names[c]) if names else c}")
        for c in classes
    ]
    shown = S.recode("actual", dict(names)).alias("actual") if names else F.col("actual")
    return wide.select(*by, shown, *cells)


def _name_slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, tp, support, predicted_n) from confusion counts."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("actual").alias("class"),
            hit.alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted_n"),
        ),
        F.struct(
            F.col("predicted").alias("class"),
            zero.alias("tp"),
            zero.alias("support"),
            F.col("n").alias("predicted_n"),
        ),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted_n")])
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """(by, class, precision, recall, f1, support)."""
    return report_from_counts(confusion_counts(df, actual, predicted, by), by)


def report_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("predicted_n")
    return per_class(counts, by).select(
        *by,
        "class",
        _ratio(tp, guessed).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(tp * 2, support + guessed).alias("f1"),
        "support",
    )


def _weighted(metric: str) -> Column:
    total = F.sum("support").cast("double")
    return F.coalesce(F.try_divide(F.sum(F.col(metric) * F.col("support")), total), F.lit(0.0))


def weighted_prf(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, precision_w, recall_w, f1), each the support-weighted mean over classes."""
    return weighted_from_counts(confusion_counts(df, actual, predicted, by), by).drop("accuracy")


def weighted_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy, precision_w, recall_w, f1). Accuracy is the weighted recall."""
    return (
        report_from_counts(counts, by)
        .groupBy(*by)
        .agg(
            _weighted("recall").alias("accuracy"),
            _weighted("precision").alias("precision_w"),
            _weighted("recall").alias("recall_w"),
            _weighted("f1").alias("f1"),
        )
    )


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, accuracy) over the rows with a label; a missing prediction is a wrong one, as in the report."""
    hit = F.coalesce((F.col(actual) == F.col(predicted)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(F.when(F.col(actual).isNotNull(), hit)).alias("accuracy"))


def trace_accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_correct, n_total, share) from the diagonal of a confusion table."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sums = counts.groupBy(*by).agg(F.sum(hit).alias("n_correct"), F.sum("n").alias("n_total"))
    share = _ratio(F.col("n_correct"), F.col("n_total"))
    return sums.withColumn("share", share)


def report_averages(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, average, precision, recall, f1, support): macro, weighted and accuracy rows.

    The accuracy row shows the accuracy in every metric column.
    """
    report = classification_report(df, actual, predicted, by)
    metrics = ["precision", "recall", "f1"]
    total = F.sum("support")
    rows = F.array(
        F.struct(
            F.lit("accuracy").alias("average"),
            *[_weighted("recall").alias(m) for m in metrics],
            total.alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("average"),
            *[F.avg(m).alias(m) for m in metrics],
            total.alias("support"),
        ),
        F.struct(
            F.lit("weighted avg").alias("average"),
            *[_weighted(m).alias(m) for m in metrics],
            total.alias("support"),
        ),
    )
    return report.groupBy(*by).agg(rows.alias("rows")).select(*by, F.inline("rows"))


def accuracy_paradox(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), high: float = 0.9
) -> DataFrame:
    """(by, class, recall, accuracy, paradox): classes never found although accuracy is high."""
    report = classification_report(df, actual, predicted, by)
    run = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # Classes of one run: a handful of rows per window.
    support = F.sum("support").over(run).cast("double")
    hits = F.sum(F.col("recall") * F.col("support")).over(run)
    acc = F.coalesce(F.try_divide(hits, support), F.lit(0.0))
    lost = (F.col("recall") == 0) & (F.col("support") > 0)
    return report.withColumn("accuracy", acc).select(
        *by, "class", "recall", "accuracy", (lost & (F.col("accuracy") >= high)).alias("paradox")
    )


def round_metrics(df: DataFrame, digits: int = 4) -> DataFrame:
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.bround(c, digits) for c in names})
