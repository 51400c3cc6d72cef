"""Exact stratified split and folds, and dense row numbers inside a class.

Rows are put in a reproducible random order by a hash of their key. Instead of sorting a class
in one task, the hash value at each wanted rank is searched for: count rows per class and hash
prefix, keep the one prefix that holds the rank, lengthen the prefix, until few rows share it.
Marking the rows is then a comparison with those hash values: no shuffle, no window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, floor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sievework.functions import portable
from sievework.functions.portable import SEED
from sievework.operators import class_quotas, profile
from sievework.session import TooMany, collect_few

_HASH = "_hash"
_STEP = 3  # hex digits per round at most: 4096 counts per open prefix
_COUNTS = 500_000  # prefix counts per round that come to the driver at most
_FEW = 512  # rows sharing a prefix that may be listed


def _prefix_counts(hashed: DataFrame, label: str, digits: int) -> list:
    """Rows (class, prefix, n), a bounded number of them, whatever the size of the table."""
    counts = hashed.groupBy(label, F.substring(_HASH, 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return collect_few(counts, f"hash prefixes over the values of the class label {label!r}")


_TEXTS = T.ArrayType(T.StringType())


def _small(hashed: DataFrame, label: str, rows: Sequence[tuple], **more: T.DataType) -> DataFrame:
    """A table of a few values per class, keyed by ``_class``."""
    fields = {"_class": hashed.schema[label].dataType, **more}
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    return hashed.sparkSession.createDataFrame(rows, schema)


def _with_class(df: DataFrame, label: str, small: DataFrame, n: int) -> DataFrame:
    """``df`` with the columns of the small table; sent to all tasks up to a checked number of rows."""
    small = F.broadcast(small) if n <= _COUNTS else small
    return df.join(small, F.col(label) == F.col("_class"), "left").drop("_class")


def _within(hashed: DataFrame, label: str, open_: Sequence[tuple]) -> DataFrame:
    """Rows whose hash begins with an open prefix of their class."""
    by_class: dict[Any, list[str]] = {}
    for c, p, _, _ in open_:
        by_class.setdefault(c, []).append(p)
    prefixes = _small(hashed, label, list(by_class.items()), _open=_TEXTS)
    kept = _with_class(hashed, label, prefixes, len(by_class))
    return kept.where(F.exists("_open", lambda p: F.col(_HASH).startswith(p))).drop("_open")


def _digits(n_open: int) -> int:
    """Hex digits a round may add so that its counts stay few, one at least."""
    return max(d for d in range(1, _STEP + 1) if d == 1 or n_open * 16**d <= _COUNTS)


def _hash_at_ranks(
    hashed: DataFrame, label: str, choose: Callable[[dict[Any, int]], Mapping[Any, set[int]]], most: int = _COUNTS
) -> tuple[dict[Any, int], dict[tuple[Any, int], str]]:
    """Class sizes, and {(class, rank): hash} of the rank-th row (1-based) in hash order.

    ``choose`` names the wanted ranks once the sizes are known. A missing label raises, and so do more
    than ``most`` classes or a million prefixes (``TooMany``).
    """
    listed = collect_few(
        hashed.groupBy(label).agg(F.count(F.lit(1)).alias("n")), f"values of the class label {label!r}", most
    )
    sizes: dict[Any, int] = {row[label]: row["n"] for row in listed}
    if None in sizes:
        raise ValueError(f"{sizes[None]} rows miss the class label {label!r}")
    depth = _digits(len(sizes))
    counts = _prefix_counts(hashed, label, depth) if sizes else []
    found: dict[tuple[Any, int], str] = {}
    # Prefix searched, rows of the class sorting before it, ranks inside it.
    open_ = [(c, "", 0, set(rs)) for c, rs in choose(sizes).items() if rs]
    before_depth = 0
    short: list[tuple] = []
    while open_:
        following = []
        by_prefix: dict[tuple[Any, str], list] = {}
        for row in sorted(counts, key=lambda r: r["prefix"]):
            by_prefix.setdefault((row[label], row["prefix"][:before_depth]), []).append(row)
        for c, p, before, wanted in open_:
            seen = before
            for row in by_prefix[c, p]:
                hit = {r for r in wanted if seen < r <= seen + row["n"]}
                if hit:
                    few = row["n"] <= _FEW or depth >= 32
                    (short if few else following).append((c, row["prefix"], seen, hit))
                seen += row["n"]
        open_ = following
        before_depth = depth
        if open_:
            depth += _digits(len(open_))
            counts = _prefix_counts(_within(hashed, label, open_), label, depth)
    if short:
        at: dict[tuple[Any, str], list[str]] = {}
        lengths = sorted({len(p) for _, p, _, _ in short})
        for row in _within(hashed, label, short).distinct().collect():
            for n in lengths:
                at.setdefault((row[label], row[_HASH][:n]), []).append(row[_HASH])
        for c, p, seen, hit in short:
            hashes = sorted(at[(c, p)])
            for r in hit:
                found[(c, r)] = hashes[min(r - seen, len(hashes)) - 1]
    return sizes, found


def _hashed(df: DataFrame, label: str, keys: Sequence[str], tag: str, seed: int) -> DataFrame:
    return df.select(label, portable.hash_hex(tag, *keys, seed=seed).alias(_HASH))


def test_quotas(sizes: Mapping[Any, int], test_size: float) -> dict[Any, int]:
    """Test rows per class: ceil(test_size*n) in total, shared out by largest remainder."""
    n = sum(sizes.values())
    n_test = ceil(test_size * n)
    share = {c: m * n_test / n for c, m in sizes.items()}
    quota = {c: floor(x) for c, x in share.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(share[c] - quota[c]), c))
    for c in by_remainder[: n_test - sum(quota.values())]:
        quota[c] += 1
    return quota


def fold_quotas(sizes: Mapping[Any, int], k: int) -> dict[Any, list[int]]:
    """Rows per class and fold: deal the class-sorted rows out to the folds in turn."""
    quotas, offset = {}, 0
    for c in sorted(sizes):
        last = offset + sizes[c] - 1
        quotas[c] = [
            max(0, (last - f) // k - (offset - 1 - f) // k) if sizes[c] else 0 for f in range(k)
        ]
        offset += sizes[c]
    return quotas


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = SEED,
    name: str = "is_test",
    most_classes: int = _COUNTS,
) -> DataFrame:
    """Add ``is_test`` 0/1 with exact per-class quotas. ``keys`` must identify a row.

    Up to ``most_classes`` classes rows are marked without a shuffle; beyond it the same rows are found by
    ``class_quotas``.
    """

    def last_ranks(sizes: dict[Any, int]) -> dict[Any, set[int]]:
        if sizes and min(sizes.values()) < 2:
            raise ValueError("every class needs at least two rows for a stratified split")
        return {c: {q} for c, q in test_quotas(sizes, test_size).items() if q > 0}

    try:
        sizes, last = _hash_at_ranks(_hashed(df, label, keys, "split", seed), label, last_ranks, most_classes)
    except TooMany:
        return class_quotas.stratified_split(df, label, keys, test_size, seed, name)
    quota = test_quotas(sizes, test_size)
    hashed = df.withColumn(_HASH, portable.hash_hex("split", *keys, seed=seed))
    rows = [(c, last[(c, q)]) for c, q in quota.items() if q > 0]
    marked = _with_class(hashed, label, _small(hashed, label, rows, _last=T.StringType()), len(rows))
    in_test = F.coalesce(F.col(_HASH) <= F.col("_last"), F.lit(False))
    return marked.withColumn(name, in_test.cast("int")).drop(_HASH, "_last")


def train_part(split: DataFrame, name: str = "is_test") -> DataFrame:
    return split.where(F.col(name) == 0).drop(name)


def test_part(split: DataFrame, name: str = "is_test") -> DataFrame:
    return split.where(F.col(name) == 1).drop(name)


def stratified_kfold(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    k: int = 5,
    seed: int = SEED,
    name: str = "fold",
    most_classes: int = _COUNTS,
) -> DataFrame:
    """Add ``fold`` in 0..k-1; per class, fold sizes differ by at most one row.

    ``most_classes`` as in ``stratified_split``.
    """

    def fold_ends(sizes: dict[Any, int]) -> dict[Any, list[int]]:
        quotas = fold_quotas(sizes, k)
        return {c: [sum(q[: f + 1]) for f in range(k)] for c, q in quotas.items()}

    def inner_ends(sizes: dict[Any, int]) -> dict[Any, set[int]]:
        if sizes and max(sizes.values()) < k:
            raise ValueError(f"{k} folds need a class with at least {k} rows")
        return {c: {e for e in es[:-1] if 0 < e < sizes[c]} for c, es in fold_ends(sizes).items()}

    try:
        sizes, at = _hash_at_ranks(_hashed(df, label, keys, "fold", seed), label, inner_ends, most_classes)
    except TooMany:
        return class_quotas.stratified_kfold(df, label, keys, k, seed, name)
    quotas, ends = fold_quotas(sizes, k), fold_ends(sizes)
    rows = []
    for c, es in ends.items():
        # The first fold whose last rank is not before a row; rows past all ends: last fold.
        used = [f for f in range(k) if quotas[c][f]]
        inner = [f for f in used if (c, es[f]) in at and f != used[-1]]
        rows.append((c, [at[(c, es[f])] for f in inner], [*inner, used[-1] if used else k - 1]))
    hashed = df.withColumn(_HASH, portable.hash_hex("fold", *keys, seed=seed))
    small = _small(hashed, label, rows, _ends=_TEXTS, _folds=T.ArrayType(T.IntegerType()))
    marked = _with_class(hashed, label, small, len(rows))
    fold = F.element_at("_folds", F.size(F.filter("_ends", lambda e: e < F.col(_HASH))) + 1)
    return marked.withColumn(name, fold).drop(_HASH, "_ends", "_folds")


def dense_numbers(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    tag: str,
    total: int,
    name: str = "number",
    seed: int = SEED,
) -> DataFrame:
    """Number rows 0..n-1 inside each group, in hash order.

    Hash prefixes cut each group into parts of even size whatever the group sizes are. Parts are
    numbered separately; the rows in front of a part are added from the small table of part sizes.
    """
    digits = 0
    while total / 16**digits > 100_000 and digits < 15:
        digits += 1
    part = F.substring(_HASH, 1, digits) if digits else F.lit("")
    rows = df.withColumn(_HASH, portable.hash_hex(tag, *keys, seed=seed)).withColumn("_part", part)
    in_part = Window.partitionBy(*group, "_part").orderBy(_HASH)
    local = rows.withColumn("_local", F.row_number().over(in_part) - 1)
    if not digits:
        return local.withColumn(name, F.col("_local").cast("long")).drop(_HASH, "_part", "_local")
    sizes = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        local.join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop(_HASH, "_part", "_local", "_before")
    )


def key_schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])
