"""Fill missing cells: median for numbers, mode for the rest.

``fit_imputer`` runs the aggregates and keeps one value per column; ``apply_imputer`` is a plain
projection with literals, so it costs no join and also works on a streaming table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import order_stats, profile
from sievework.operators.project import missing, numeric_columns


@dataclass(frozen=True)
class ImputerFit:
    """Fill values of the columns that had missing cells when fitted."""

    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, Any] = field(default_factory=dict)
    n_missing: dict[str, int] = field(default_factory=dict)


def fit_imputer(
    df: DataFrame, columns: Sequence[str] | None = None, n_rows: int | None = None
) -> ImputerFit:
    chosen = df.select(*columns) if columns else df
    counts = {
        r["column_name"]: r["n_missing"]
        for r in profile.missing_counts(chosen).collect()
        if r["n_missing"] > 0
    }
    numeric = [c for c in numeric_columns(chosen) if c in counts]
    other = [c for c in chosen.columns if c in counts and c not in numeric]
    middle = order_stats.quantile_table(chosen, numeric, [0.5], n_rows=n_rows)
    medians = {c: q[0] for c, q in middle.items()}
    modes = (
        {r["column_name"]: r["top"] for r in profile.text_description(chosen, other).collect()}
        if other
        else {}
    )
    return ImputerFit(medians, modes, counts)


def apply_imputer(df: DataFrame, fit: ImputerFit, add_indicator: bool = True) -> DataFrame:
    """Fill the fitted columns; ``<column>_was_missing`` 0/1 marks filled numbers."""
    filled, flags = [], []
    for c in df.columns:
        if c in fit.medians:
            kind = df.schema[c].dataType
            # An integer column may get a fractional median, so it becomes double.
            target = "double" if kind.typeName() in ("byte", "short", "integer", "long") else kind
            fill = F.lit(fit.medians[c]).cast(target)
            filled.append(F.when(missing(df, c), fill).otherwise(F.col(c).cast(target)).alias(c))
            if add_indicator:
                flags.append(missing(df, c).cast("int").alias(f"{c}_was_missing"))
        elif c in fit.modes:
            filled.append(
                F.coalesce(F.col(c), F.lit(fit.modes[c]).cast(df.schema[c].dataType)).alias(c)
            )
        else:
            filled.append(F.col(c))
    return df.select(*filled, *flags)


def impute(df: DataFrame, columns: Sequence[str] | None = None, add_indicator: bool = True) -> DataFrame:
    return apply_imputer(df, fit_imputer(df, columns), add_indicator)
