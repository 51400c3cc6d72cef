"""The aggregated table behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators.outliers import Fence
from sievework.operators.project import missing

METRICS = ["accuracy", "precision_w", "recall_w", "f1"]


def class_bars(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, share of its part), counted in one pass."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        with_total = counts.join(totals, list(by))
    else:
        with_total = counts.withColumn("total", counts.agg(F.sum("n")).scalar())
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    return with_total.select(*by, "value", "n", share.alias("share"))


def boxplot_stats(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """Quartiles, whisker ends (last value inside the fence) and outlier count per column."""
    cells = []
    for c, f in fences.items():
        x = S.nan_to_null(F.col(c).cast("double"))
        inside = F.when(~S.outside(c, f.lower, f.upper), x)
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(f.q1).alias("q1"),
                F.lit(f.median).alias("median"),
                F.lit(f.q3).alias("q3"),
                F.min(inside).alias("whisker_low"),
                F.max(inside).alias("whisker_high"),
                F.count_if(S.outside(c, f.lower, f.upper)).alias("n_outliers"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def outlier_points(df: DataFrame, column: str, fence: Fence, keep: Sequence[str] = ()) -> DataFrame:
    """The points drawn beyond the whiskers."""
    return df.where(S.outside(column, fence.lower, fence.upper)).select(*keep, column)


def missing_map(df: DataFrame, block: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_block, column_name, share_missing): the missing-cell picture by blocks of rows."""
    columns = list(columns or df.columns)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.avg(missing(df, c).cast("double")).alias("share_missing"),
            )
            for c in columns
        ]
    )
    blocks = df.groupBy(block.alias("row_block")).agg(cells.alias("cells"))
    return blocks.select("row_block", F.inline("cells"))


def scatter_bins(
    df: DataFrame, x: str, y: str, label: str, x_width: float, y_width: float
) -> DataFrame:
    """(x_bin, y_bin, label, n): a scatter plot as counts per cell."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            F.floor(F.col(x) / F.lit(x_width)).cast("long").alias("x_bin"),
            F.floor(F.col(y) / F.lit(y_width)).cast("long").alias("y_bin"),
            label,
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def metrics_long(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(model, smote, metric, value)."""
    return results.select("model", "smote", *metrics).unpivot(
        ["model", "smote"], list(metrics), "metric", "value"
    )


def metrics_wide(long: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Back to one column per metric."""
    return long.groupBy("model", "smote").pivot("metric", list(metrics)).agg(F.max("value"))


def effect_regions(effect: DataFrame) -> DataFrame:
    """(model, f1_none, f1_smote, region) for the with/without scatter."""
    region = (
        F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "worsened").otherwise("unchanged")
    )
    return effect.select("model", "f1_none", "f1_smote", region.alias("region"))


def top_candidate_bars(cv: DataFrame, label: Column, n: int = 20) -> DataFrame:
    """(candidate_id, label, mean, std, is_best) of the n best candidates."""
    top = cv.orderBy("rank", "candidate_id").limit(n)
    return top.select(
        "candidate_id", label.alias("label"), "mean", "std", (F.col("rank") == 1).alias("is_best")
    )
