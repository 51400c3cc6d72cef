"""SMOTE: bring every class up to the largest one with rows between near neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import portable
from sievework.functions.portable import SEED
from sievework.operators import neighbors, sampling
from sievework.session import collect_few, materialize

# Synthetic rows counted out per chunk, and the most tasks the chunks are spread over.
CHUNK = 100_000
MAX_TASKS = 10_000
# Base rows, with their neighbours, that are sent to all tasks at most; beyond it both sides are shuffled.
FEW_BASES = 10_000


def _counts(df: DataFrame, within: Sequence[str], label: str) -> dict[tuple, dict[Any, int]]:
    """{(within values): {class: rows}}."""
    counted = collect_few(
        df.groupBy(*within, label).agg(F.count(F.lit(1)).alias("n")), f"values of {label!r}"
    )
    sizes: dict[tuple, dict[Any, int]] = {}
    for row in counted:
        sizes.setdefault(tuple(row[w] for w in within), {})[row[label]] = row["n"]
    return sizes


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    k: int = 3,
    within: Sequence[str] = (),
    seed: int = SEED,
    cell_rows: int = neighbors.CELL_ROWS,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Original rows plus, per class, as many synthetic rows as it lacks to the largest class.

    Synthetic row i takes a random row of its class, one of that row's k nearest neighbours of the
    same class, and a random point on the line between them. All draws depend only on
    (seed, within, class, i). With ``within`` columns (for example the left-out fold) every part
    is balanced on its own, all parts in the same jobs. ``near`` gives the rows of the (within, class) groups
    it is handed with their k neighbours, for callers that know a shorter way than searching each part.

    Result: within, label, features, key (NULL when synthetic), number (NULL when original).
    A class with k rows or fewer raises.
    """
    features, within = list(features), list(within)
    spark = df.sparkSession
    df = df.select(
        *within, label, key, *[F.col(f).cast("double").alias(f) for f in features]
    )
    originals = df.withColumn("number", F.lit(None).cast("long"))
    sizes = _counts(df, within, label)
    lacking = [
        (part, c, n, max(classes.values()) - n)
        for part, classes in sizes.items()
        for c, n in classes.items()
        if n < max(classes.values())
    ]
    if not lacking:
        return originals
    for _, c, n, _ in lacking:
        if n <= k:
            raise ValueError(f"class {c!r} has {n} rows, SMOTE with k={k} needs more than {k}")

    group = [*within, label]
    # One row per class that needs more rows; Spark broadcasts it as long as its known size allows.
    long_ = [T.StructField(c, T.LongType()) for c in ("_size", "_need")]
    plan = spark.createDataFrame(
        [(*part, c, n, need) for part, c, n, need in lacking],
        T.StructType([*sampling.key_schema(df, group).fields, *long_]),
    )
    if near is None:
        # Read several times below; written once so the input is not scanned each time.
        minority = materialize(df.join(plan.select(*group), group), "minority")
        listed = neighbors.knn_within_group(minority, features, key, k, group, cell_rows)
    else:
        listed = near(plan.select(*group))
    total = sum(n for _, _, n, _ in lacking)
    numbered = sampling.dense_numbers(listed, group, [*group, key], "smote", total, "_base", seed)
    numbered = numbered.select(*group, "_base", *features, "neighbors")

    # The rows to make, counted out in chunks spread over many tasks, never from one task.
    n_chunks = sum(-(-need // CHUNK) for *_, need in lacking)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_need - 1) div {CHUNK}")))
    first = F.col("_chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("_need")) - 1
    made = (
        plan.withColumn("_chunk", chunk)
        .repartition(min(n_chunks, MAX_TASKS))
        .select(*group, "_size", F.explode(F.sequence(first, last)).alias("number"))
    )
    at = [*group, "number"]
    draws = made.select(
        *group,
        "number",
        F.floor(portable.uniform("base", *at, seed=seed) * F.col("_size")).cast("long").alias("_base"),
        F.floor(portable.uniform("nn", *at, seed=seed) * F.lit(k)).cast("int").alias("_pick"),
        portable.uniform("gap", *at, seed=seed).alias("_gap"),
    )
    # Spark takes the draws for as small as the plan they are counted out from, and would broadcast millions of rows.
    draws, numbered = (draws, F.broadcast(numbered)) if total <= FEW_BASES else (draws.hint("merge"), numbered)
    joined = draws.join(numbered, [*group, "_base"])
    other = F.col("neighbors")[F.col("_pick")]
    synthetic = joined.select(
        *group,
        F.lit(None).cast(df.schema[key].dataType).alias(key),
        *[(F.col(f) + F.col("_gap") * (other[f] - F.col(f))).alias(f) for f in features],
        "number",
    )
    return originals.unionByName(synthetic)


def materialized_smote(df: DataFrame, features: Sequence[str], label: str, key: str, **options) -> DataFrame:
    """Resampled rows written once, for callers that read them many times."""
    return materialize(smote(df, features, label, key, **options), "resampled")


def fold_training_sets(df: DataFrame, fold: str, k: int, name: str = "left_out") -> DataFrame:
    """Each row once per fold it trains for, that is for every fold but its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
    return df.withColumn(name, F.explode(others))


def smote_per_fold(
    folded: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    folds: int,
    k: int = 3,
    fold: str = "fold",
    seed: int = SEED,
    cell_rows: int = neighbors.CELL_ROWS,
) -> DataFrame:
    """Balanced training rows for every left-out fold; left-out rows are never touched.

    Neighbours are searched for once, over the rows of all folds.
    """
    training = fold_training_sets(folded, fold, folds)
    rows = folded.select(key, label, fold, *[F.col(f).cast("double").alias(f) for f in features])

    def near(groups: DataFrame) -> DataFrame:
        lacking = materialize(rows.join(groups.select(label).distinct(), label), "minority")
        found = neighbors.knn_leaving_out(lacking, features, key, k, [label], fold, folds, cell_rows=cell_rows)
        return materialize(found.join(groups, ["left_out", label]), "fold-neighbors")

    return smote(training, features, label, key, k, ["left_out"], seed, cell_rows, near)


def resample_effect(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(label, n_before, n_after)."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n_after"))
    zero = F.lit(0)
    return (
        b.join(a, label, "full")
        .select(
            label,
            F.coalesce("n_before", zero).alias("n_before"),
            F.coalesce("n_after", zero).alias("n_after"),
        )
        .orderBy(label)
    )
