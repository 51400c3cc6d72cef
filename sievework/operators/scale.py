"""Standard scaling with the population standard deviation; a constant column is only centred."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import outliers


@dataclass(frozen=True)
class ScalerFit:
    mean: dict[str, float]
    std: dict[str, float]


def fit_scaler(df: DataFrame, features: Sequence[str], digits: int | None = None) -> ScalerFit:
    """Fit on the training part only. ``digits`` rounds the two parameters, which makes the
    scaled values independent of the order in which partitions were summed."""
    fit = outliers.fit_moments(df, features)
    mean = {c: m for c, (m, _) in fit.items()}
    std = {c: s for c, (_, s) in fit.items()}
    if digits is not None:
        mean = {c: round(m, digits) for c, m in mean.items()}
        std = {c: round(s, digits) for c, s in std.items()}
    return ScalerFit(mean, {c: s if s else 1.0 for c, s in std.items()})


def apply_scaler(df: DataFrame, fit: ScalerFit) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - F.lit(fit.mean[c])) / F.lit(fit.std[c]) for c in fit.mean}
    )
