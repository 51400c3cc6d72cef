"""Duplicate rows. Missing values count as equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows.

    Equal rows are counted map-side first, so a row repeated everywhere moves one record per
    task.
    """
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_duplicates_first(
    df: DataFrame, columns: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Keep the first row of each key under ``order``.

    Spark limits each group to one row before the shuffle, so a hot key does not travel.
    """
    w = Window.partitionBy(*columns).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
