"""A key join that survives a key holding a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on, or from 1/MAX_HOT of the table if that is more, so there
# can never be more than MAX_HOT hot keys and their list is always small enough to broadcast.
HOT_ROWS = 200_000
MAX_HOT = 2_000


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique on ``keys``).

    Rows of a hot key are spread over several salts by ``spread`` (a per-row value) and only that
    key's lookup row is repeated, once per salt.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if total <= hot_rows:
        return rows.join(lookup, list(keys))
    limit = max(hot_rows, total // MAX_HOT)
    hot = F.broadcast(
        counts.where(F.col("_n") > limit).select(
            *keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts")
        )
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = rows.join(hot, list(keys), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts.cast("long")).cast("int")
    )
    right = lookup.join(hot, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"]).drop("_salt")
