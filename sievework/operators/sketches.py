"""Quantile sketches that are kept with a table and merged when rows are added.

A KLL sketch of a column takes some kilobytes whatever the number of rows, and sketches of two batches
merge into one as good as a sketch of both. New rows so need one pass over themselves, never over the
old ones. Minimum and maximum are exact; other quantiles have the rank error of ``rank_bound``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialize

#: Size parameter: a sketch of this size holds some 6,000 doubles.
SIZE = 2048


def rank_bound(size: int = SIZE) -> float:
    """Normalised rank error with 99 % confidence for one quantile (published fit), twice over.

    A table of many quantiles asks for more than one; twice the bound is beyond five deviations.
    """
    return 2 * 2.296 / size**0.9021


def sketch_table(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(by.., column_name, sketch, n) with a row per group and column, in one pass.

    NULL and NaN take no part. A column without values has no row, and an empty table none at all.
    ``by`` must not hold ``column_name``, ``sketch`` or ``n``.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    cells = [F.struct(F.lit(c).alias("column_name"), F.kll_sketch_agg_double(x, size).alias("sketch"), F.count(x).alias("n")) for c, x in value.items()]
    found = df.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return found.select(*by, F.inline("cells")).where("n > 0")


def merge(tables: Sequence[DataFrame], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """One sketch table for all rows that went into the given ones."""
    together = reduce(DataFrame.unionByName, tables)
    return together.groupBy(*by, "column_name").agg(
        F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n")
    )


def quantiles(sketched: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The rows of a sketch table without the sketch, one per probability, with ``prob`` and ``value``."""
    ranks = [F.lit(float(p)) for p in probs]
    cells = [F.struct(p.alias("prob"), F.kll_sketch_get_quantile_double("sketch", p).alias("value")) for p in ranks]
    kept = [c for c in sketched.columns if c != "sketch"]
    return sketched.select(*kept, F.inline(F.array(*cells)))


def rank_errors(df: DataFrame, found: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``found`` with ``error``: how far the wanted rank is from the true ranks of the value, 0 if among them.

    One pass over ``df``. Groups and columns without values have no row. A sketch drops values at random, so
    a second run may give other quantiles: ``found`` is written once.
    """
    found = materialize(found, "quantiles")
    x = F.col(column).cast("double")
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if by:
        asked = found.groupBy(*by).agg(F.collect_set("value").alias("_asked"))
        rows = rows.join(asked, list(by))
    else:
        rows = rows.withColumn("_asked", F.array(*[F.lit(r["value"]) for r in found.select("value").distinct().collect()]))
    # Counted per asked value, in tasks first: at most a row per group and probability is shuffled by a task.
    each = rows.select(*by, "_x", F.lit(1).alias("_n"), F.explode("_asked").alias("value"))
    ranks = each.groupBy(*by, "value").agg(
        F.sum(F.when(F.col("_x") < F.col("value"), F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("_x") <= F.col("value"), F.col("_n")).otherwise(0)).alias("_upto"),
    )
    wanted = F.col("prob") * F.col("n")
    error = F.greatest(F.col("_below") - wanted, wanted - F.col("_upto"), F.lit(0.0)) / F.col("n")
    return found.join(ranks, [*by, "value"]).withColumn("error", error).drop("_below", "_upto")
