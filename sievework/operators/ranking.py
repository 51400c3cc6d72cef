"""Model-comparison tables over (model, smote, metrics) rows.

These tables hold one row per run, so ordering them whole is cheap; ties go to the first name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.functions import scalars as S


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a column one table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def rank_models(results: DataFrame, metric: str = "f1") -> DataFrame:
    """All runs by metric, best first, numbered from 0."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), "model", "smote")
    return results.withColumn("position", F.row_number().over(order) - 1).orderBy("position")


def rank_within_scenario(results: DataFrame, metric: str = "f1") -> DataFrame:
    """Runs of each scenario by metric, numbered from 1."""
    order = Window.partitionBy("smote").orderBy(F.desc(metric), "model")
    return results.withColumn("rank", F.row_number().over(order))


def competition_rank(
    df: DataFrame, metric: str, by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Rank, best first; equal values share the lowest rank (1, 1, 3)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.rank().over(w.orderBy(F.desc(metric))))


def scenario_pairs(
    results: DataFrame, without: str = "none", with_: str = "smote_k3", metric: str = "f1"
) -> DataFrame:
    """(model, f1_none, f1_smote) of the models present in both scenarios."""
    a = results.where(F.col("smote") == without).select("model", F.col(metric).alias(f"{metric}_none"))
    b = results.where(F.col("smote") == with_).select("model", F.col(metric).alias(f"{metric}_smote"))
    return a.join(b, "model")


def scenario_only(results: DataFrame, present: str, absent: str) -> DataFrame:
    """Models with a run in one scenario and none in the other."""
    a = results.where(F.col("smote") == present).select("model")
    b = results.where(F.col("smote") == absent).select("model")
    return a.join(b, "model", "left_anti").distinct()


def resampling_effect(results: DataFrame, digits: int = 4) -> DataFrame:
    """(model, f1_none, f1_smote, delta, mark), largest gain first.

    The metric is rounded first, so the delta is that of the shown numbers.
    """
    pairs = scenario_pairs(results.withColumn("f1", F.bround("f1", digits)))
    delta = F.bround(F.col("f1_smote") - F.col("f1_none"), digits)
    return (
        pairs.withColumn("delta", delta)
        .withColumn("mark", S.sign_mark("delta"))
        .orderBy(F.desc("delta"), "model")
    )


def effect_counts(effect: DataFrame) -> DataFrame:
    """(n_improved, n_worsened); an unchanged model counts as worsened."""
    better = F.count_if(F.col("delta") > 0)
    return effect.agg(
        better.alias("n_improved"), (F.count(F.lit(1)) - better).alias("n_worsened")
    )


def top_gains(effect: DataFrame, n: int = 3) -> DataFrame:
    better = effect.where(F.col("delta") > 0).select("model", "delta")
    return better.orderBy(F.desc("delta"), "model").limit(n)


def top_models(results: DataFrame, n: int = 4, metric: str = "f1") -> DataFrame:
    return results.orderBy(F.desc(metric), "model", "smote").limit(n)


def best_per_scenario(results: DataFrame, metric: str = "f1") -> DataFrame:
    """Best run of each scenario and, marked ``overall``, the best of all."""
    lead = F.min(F.struct((-F.col(metric)).alias("neg"), "model", "smote", metric))
    each = results.groupBy(F.col("smote").alias("scope")).agg(lead.alias("b"))
    whole = results.agg(lead.alias("b")).select(F.lit("overall").alias("scope"), "b")
    return each.unionByName(whole).select(
        "scope", F.col("b.model").alias("model"), F.col("b.smote").alias("smote"), F.col(f"b.{metric}").alias(metric)
    )


def final_comparison(
    results: DataFrame, picks: Sequence[tuple[str, str, str, str]], digits: int = 4
) -> DataFrame:
    """Chosen runs with remark: picks are (model, smote, tuning, remark)."""
    parts = []
    for model, scenario, tuning, remark in picks:
        chosen = results.where((F.col("model") == model) & (F.col("smote") == scenario))
        parts.append(
            chosen.select(
                "model",
                "smote",
                F.lit(tuning).alias("tuning"),
                *[F.bround(c, digits).alias(c) for c in ("accuracy", "precision_w", "recall_w", "f1")],
                F.lit(remark).alias("remark"),
            )
        )
    return union_all(*parts)


def report_rows(results: DataFrame) -> DataFrame:
    """Text cells for a printed table; a missing area under the curve is a dash."""
    cells = [S.fmt_fixed(c).alias(c) for c in ("accuracy", "precision_w", "recall_w", "f1")]
    auc = F.coalesce(S.fmt_fixed(F.col("roc_auc")), F.lit("-"))
    shown = F.when(F.col("roc_auc").isNull(), F.lit("-")).otherwise(auc)
    return results.select("model", "smote", *cells, shown.alias("roc_auc"))
