"""Column lists, names, filters, constants and feature vectors."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scalars as S


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN for floating columns."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def nan_as_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in floating columns; after that every aggregate skips it."""
    floating = {
        f.name: S.nan_to_null(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


def standardize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores; two names must not become one."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after standardising: {clash}")
    return df.toDF(*names)


def rename_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def select_pattern(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Columns matching any of the names or ``*`` patterns, in table order."""
    return df.select([c for c in df.columns if any(fnmatch.fnmatchcase(c, p) for p in patterns)])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def with_constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def head_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows under an explicit order (a distributed table has no row positions)."""
    if not order:
        raise ValueError("head_n needs an order")
    return df.orderBy(*order).limit(n)


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row count."""
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
            )
            for i, f in enumerate(df.schema.fields, 1)
        ]
    )
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.inline(fields), "n_rows")


def assemble_features(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Ordered columns to one vector; a missing value is an error, not a silent drop."""
    return VectorAssembler(
        inputCols=list(features), outputCol=output, handleInvalid="error"
    ).transform(df)
