"""Outlier fences, z-scores and capping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import order_stats, profile

WHISKER = 1.5
Z_LIMIT = 3.0


@dataclass(frozen=True)
class Fence:
    q1: float
    median: float
    q3: float
    lower: float
    upper: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1


def fit_fences(
    df: DataFrame, columns: Sequence[str], whisker: float = WHISKER, n_rows: int | None = None
) -> dict[str, Fence]:
    """Fences q1 - whisker*iqr and q3 + whisker*iqr for all columns together."""
    fences = {}
    quartiles = order_stats.quantile_table(df, columns, [0.25, 0.5, 0.75], n_rows=n_rows)
    for c, (q1, q2, q3) in quartiles.items():
        if q1 is None:
            raise ValueError(f"column {c!r} has no values")
        fences[c] = Fence(q1, q2, q3, q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1))
    return fences


def _per_column(df: DataFrame, masks: dict[str, Column], count: str, pct: str) -> DataFrame:
    """(column_name, count, pct of all rows) for one mask per column, in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.count_if(mask).alias(count))
            for c, mask in masks.items()
        ]
    )
    one = df.agg(cells.alias("cells"), F.count(F.lit(1)).alias("_rows"))
    share = F.try_divide(F.col(count) * F.lit(100.0), F.col("_rows"))
    return one.select(F.inline("cells"), "_rows").select("column_name", count, share.alias(pct))


def fence_table(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """Per column: quartiles, iqr, fences, and count and percent of rows outside."""
    masks = {c: S.outside(c, f.lower, f.upper) for c, f in fences.items()}
    counted = _per_column(df, masks, "n_iqr", "pct_iqr")

    def fixed(attribute: str) -> Column:
        values = {c: float(getattr(f, attribute)) for c, f in fences.items()}
        return S.recode("column_name", values).alias(attribute)

    return counted.select(
        "column_name", *[fixed(a) for a in ("q1", "q3", "iqr", "lower", "upper")], "n_iqr", "pct_iqr"
    )


def zscore(c: str, mean: float | None, std: float | None) -> Column:
    """(x - mean) / std, NULL for a constant column and for NaN."""
    return F.try_divide(S.nan_to_null(c) - F.lit(mean), F.lit(std))


def fit_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    rows = profile.moments(df, columns).collect()
    return {r["column_name"]: (r["mean"], r["std_pop"]) for r in rows}


def zscore_table(df: DataFrame, columns: Sequence[str], limit: float = Z_LIMIT) -> DataFrame:
    """Per column: mean, population std, and count and percent of rows with |z| over the limit."""
    fit = fit_moments(df, columns)
    masks = {c: F.abs(zscore(c, *fit[c])) > F.lit(limit) for c in columns}
    counted = _per_column(df, masks, "n_zscore", "pct_zscore")
    mean = S.recode("column_name", {c: fit[c][0] for c in columns}).alias("mean")
    std = S.recode("column_name", {c: fit[c][1] for c in columns}).alias("std_pop")
    return counted.select("column_name", mean, std, "n_zscore", "pct_zscore")


def cap_to_fences(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """Pull values outside the fences back onto them; missing stays missing."""
    return df.withColumns({c: S.clip(c, f.lower, f.upper) for c, f in fences.items()})


def capping_report(df: DataFrame, fences: dict[str, Fence]) -> DataFrame:
    """(column_name, n_before, n_after, n_capped), before and after in the same pass."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(S.outside(c, f.lower, f.upper)).alias("n_before"),
                F.count_if(
                    (S.clip(c, f.lower, f.upper) < F.lit(f.lower))
                    | (S.clip(c, f.lower, f.upper) > F.lit(f.upper))
                ).alias("n_after"),
            )
            for c, f in fences.items()
        ]
    )
    counted = df.agg(cells.alias("cells")).select(F.inline("cells"))
    return counted.withColumn("n_capped", F.col("n_before") - F.col("n_after"))
