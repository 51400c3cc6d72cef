"""Stratified split and folds for any number of classes.

Class sizes stay a table. What needs an order over all classes (places in the deal, ties between equal
remainders) is a running total over ranges of labels, and rows are numbered inside even hash parts of
their class, so neither many classes nor a class with most rows comes together in one task or on the driver.
The rows chosen are those of ``sampling``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievework.functions import portable
from sievework.functions.portable import SEED
from sievework.operators.running import total_before_all
from sievework.session import materialize

_HASH, _PART = "_hash", "_part"
#: Hash parts hold about so many rows of the largest possible class.
PART_ROWS = 1_000_000


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """(label, _n) as a written table; a missing label raises."""
    sizes = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    missing = sizes.where(F.col(label).isNull()).first()
    if missing is not None:
        raise ValueError(f"{missing['_n']} rows miss the class label {label!r}")
    return sizes


def test_quotas(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """(label, _quota): ceil(test_size * rows) in total, shared out by largest remainder.

    A remainder depends on the size alone, and sizes differ among few classes: n rows have at most
    sqrt(2 n) different ones. Only the remainder at which the extra rows end has ties to break.
    """
    n, least = sizes.agg(F.sum("_n"), F.min("_n")).first()
    if n is None:
        return sizes.select(label, F.col("_n").alias("_quota"))
    if least < 2:
        raise ValueError("every class needs at least two rows for a stratified split")
    n_test = ceil(test_size * n)
    share = (F.col("_n") * F.lit(n_test)).cast("double") / F.lit(float(n))
    shared = sizes.select(label, F.floor(share).alias("_floor"), (share - F.floor(share)).alias("_rest"))
    by_rest = shared.groupBy("_rest").agg(F.count(F.lit(1)).alias("n"), F.sum("_floor").alias("floors"))
    extra = n_test - by_rest.agg(F.sum("floors")).first()[0]
    upto = Window.orderBy(F.desc("_rest"))
    cut = (
        by_rest.select("_rest", "n", F.sum("n").over(upto).alias("upto"))
        .where((F.col("upto") >= extra) & (F.col("upto") - F.col("n") < extra))
        .first()
    )
    if cut is None:  # no extra rows
        return shared.select(label, F.col("_floor").alias("_quota"))
    left = extra - (cut["upto"] - cut["n"])
    at = F.lit(cut["_rest"])
    clear = shared.where(F.col("_rest") != at).select(
        label, (F.col("_floor") + (F.col("_rest") > at).cast("long")).alias("_quota")
    )
    tied = total_before_all(shared.where(F.col("_rest") == at).withColumn("_one", F.lit(1)), label, "_one", "_place")
    return clear.unionByName(
        tied.select(label, (F.col("_floor") + (F.col("_place") < left).cast("long")).alias("_quota"))
    )


def fold_ends(sizes: DataFrame, label: str, k: int) -> DataFrame:
    """(label, _ends): the last rank of each fold when rows in class order are dealt to the folds in turn."""
    most = sizes.agg(F.max("_n")).first()[0]
    if most is not None and most < k:
        raise ValueError(f"{k} folds need a class with at least {k} rows")
    placed = total_before_all(sizes, label, "_n", "_offset")

    def dealt(last: Column, f: int) -> Column:
        """Places up to ``last`` that fold f gets: the floor of (last - f) / k, plus one."""
        x = last - F.lit(f)
        return (x - F.pmod(x, F.lit(k))) / F.lit(k)

    ends, total = [], F.lit(0)
    for f in range(k):
        first, last = F.col("_offset"), F.col("_offset") + F.col("_n") - 1
        total = total + (dealt(last, f) - dealt(first - 1, f)).cast("long")
        ends.append(total)
    return placed.select(label, F.array(*ends).alias("_ends"))


def _ranked(df: DataFrame, label: str, keys: Sequence[str], tag: str, seed: int, facts: DataFrame, n: int) -> DataFrame:
    """``df`` with ``_rank`` of the row in its class, from 1 in hash order, and the columns of ``facts``.

    ``facts`` has a row per class. It meets the parts of a class first, which are few, so that rows are
    joined by (class, part): the same even partitioning that numbers them.
    """
    digits = 0
    while n / 16**digits > PART_ROWS and digits < 15:
        digits += 1
    part = F.substring(_HASH, 1, digits) if digits else F.lit("")
    rows = df.withColumn(_HASH, portable.hash_hex(tag, *keys, seed=seed)).withColumn(_PART, part)
    parts = rows.groupBy(label, _PART).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(label).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(label, _PART).orderBy(_HASH, *keys)))
    joined = local.join(offsets.join(facts, label), [label, _PART])
    return joined.withColumn("_rank", F.col("_before") + F.col("_local")).drop(_HASH, _PART, "_local", "_before")


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """As ``sampling.stratified_split``, for any number of classes. An empty table gives an empty one."""
    sizes = class_sizes(df, label)
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    quotas = materialize(test_quotas(sizes, label, test_size), "test-quotas")
    ranked = _ranked(df, label, keys, "split", seed, quotas, n)
    marked = ranked.withColumn(name, (F.col("_rank") <= F.col("_quota")).cast("int"))
    return marked.select(*df.columns, name)


def stratified_kfold(
    df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """As ``sampling.stratified_kfold``, for any number of classes. An empty table gives an empty one."""
    sizes = class_sizes(df, label)
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    ends = materialize(fold_ends(sizes, label, k), "fold-ends")
    ranked = _ranked(df, label, keys, "fold", seed, ends, n)
    fold = F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int")
    return ranked.withColumn(name, fold).select(*df.columns, name)
