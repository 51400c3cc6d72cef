"""Running totals over an ordered column without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.session import materialize

# Groups up to this many rows are summed in one window; beyond it a range holds about so many.
DIRECT_ROWS = 1_000_000
_RANGE_ROWS = 100_000
# Ranges at most, and the accuracy of the sketch that cuts them: its buffer does not grow with the rows.
_MOST_RANGES = 2_000
_SKETCH = 10_000


def total_before(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    name: str,
    n_rows: int,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same group that sort before this one.

    ``order`` must be unique within a group; NULL sorts first and NaN last. Beyond ``direct_rows`` the
    order column is cut into ranges of about ``_RANGE_ROWS`` rows: totals per range are summed up in a
    small table, and only the rest is summed inside a range.
    """
    before = Window.unboundedPreceding
    if n_rows <= direct_rows:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(before, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    cuts = max(1, min(_MOST_RANGES, -(-n_rows // _RANGE_ROWS)))
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    x = F.col(order).cast("double")
    grid = F.array(*[F.lit(p) for p in probs])
    found = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), grid, _SKETCH).alias("q"))
    inner = {q for q in found.first()["q"] or [] if abs(q) != float("inf")}
    splits = [float("-inf"), *sorted(inner), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket", handleInvalid="keep")
    bucketed = placed.transform(df.withColumn("_order", x)).drop("_order")
    bucketed = bucketed.withColumn("_bucket", F.when(x.isNotNull(), F.col("_bucket")).otherwise(F.lit(-1.0)))
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(before, -1)
    local = bucketed.withColumn("_local", F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(before, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    return (
        local.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )


def total_before_all(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows of the table that sort before this one; ``order`` must be unique.

    Rows are dealt out by ranges of ``order`` and written once, so that a range stays what it is when a
    task is repeated; the totals of the ranges, one row a partition, are summed up on their own.
    """
    ranged = materialize(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.unboundedPreceding
    local = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(before, -1))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    over = Window.orderBy("_range").rowsBetween(before, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    summed = ranged.withColumn("_local", F.coalesce(local, F.lit(0))).join(F.broadcast(offsets), "_range")
    return summed.withColumn(name, F.col("_before") + F.col("_local")).drop("_range", "_before", "_local")
