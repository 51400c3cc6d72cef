"""Exact order statistics without sorting a whole column in one task.

The built-in exact percentile keeps every distinct value of a column in one buffer, which is the
quickest way on a small table, and is used there. Beyond it, the wanted ranks are closed in on. A
round has two passes: a sketch of the values between two bounds gives values a little below and
above a rank, then the rows below, at, between and above these are counted. Either the rank falls on
one of the two values, or only the rows strictly between them are left: at most a few in ten thousand,
however the values are distributed, infinities and heavy ties included. What is left after a round
or two fits one buffer. No row is moved, and both ways give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative rank error of the sketches is one by this.
ACCURACY = 10_000
# Up to this many rows the built-in percentile's buffer is known to be small.
DIRECT_ROWS = 100_000


def _value(column: str):
    """Doubles without NaN, so that ranks count only present values."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _between(c: str, lo: float | None, hi: float | None) -> Column:
    """Values strictly inside the bounds; None is no bound."""
    x = _value(c)
    if lo is not None:
        x = F.when(x > F.lit(lo), x)
    return x if hi is None else F.when(x < F.lit(hi), x)


def _narrow(
    df: DataFrame,
    wanted: Mapping[str, set[int]],
    counts: Mapping[str, int],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = ACCURACY,
) -> dict:
    """Values at the wanted 0-based ranks, as {(column, rank): value}."""
    found: dict[tuple[str, int], float] = {}
    # (column, open bounds) -> rows below the open range, rows inside it, ranks wanted inside.
    ranges = {(c, None, None): (0, counts[c], ranks) for c, ranks in wanted.items() if ranks}
    while ranges:
        few = {k: v for k, v in ranges.items() if v[1] <= max(direct_rows, 1)}
        many = [(k, v) for k, v in ranges.items() if k not in few]
        if few:
            # No more than direct_rows values per range.
            listed = df.agg(
                *[F.sort_array(F.collect_list(_between(*k))).alias(f"v_{i}") for i, k in enumerate(few)]
            ).first()
            for i, ((c, _, _), (below, _, ranks)) in enumerate(few.items()):
                found.update({(c, r): listed[i][r - below] for r in ranks})
        if not many:
            break
        margin = 2 / accuracy
        probes = []
        for _, (below, n, ranks) in many:
            at = [(r - below) / n for r in sorted(ranks)]
            probes.append([min(1.0, max(0.0, p + d)) for p in at for d in (-margin, margin)])
        near = df.agg(
            *[
                F.percentile_approx(_between(*k), F.array(*[F.lit(p) for p in probe]), accuracy).alias(f"q_{i}")
                for i, ((k, _), probe) in enumerate(zip(many, probes))
            ]
        ).first()
        asked = [
            (k, below, r, near[i][2 * j], near[i][2 * j + 1])
            for i, (k, (below, _, ranks)) in enumerate(many)
            for j, r in enumerate(sorted(ranks))
        ]
        pairs = list(dict.fromkeys((k, a, b) for k, _, _, a, b in asked))
        cells = []
        for i, (k, a, b) in enumerate(pairs):
            x = _between(*k)
            for name, mask in (("lt", x < a), ("a", x == a), ("in", (x > a) & (x < b)), ("b", x == b)):
                cells.append(F.count_if(mask).alias(f"{name}_{i}"))
        sums = df.agg(*cells).first()
        following: dict[tuple, tuple[int, int, set[int]]] = {}
        for k, below, r, a, b in asked:
            i = pairs.index((k, a, b))
            less, at_a, inside, at_b = (sums[f"{name}_{i}"] for name in ("lt", "a", "in", "b"))
            c, lo, hi = k
            first = below + less  # rank of the first row equal to a
            if r < first:  # outside what the sketch promised: still a narrower range
                key, start, n = (c, lo, a), below, less
            elif r < first + at_a:
                found[(c, r)] = a
                continue
            elif r < first + at_a + inside:
                key, start, n = (c, a, b), first + at_a, inside
            elif a < b and r < first + at_a + inside + at_b:
                found[(c, r)] = b
                continue
            else:
                start = first + at_a + inside + (at_b if a < b else 0)
                key, n = (c, b, hi), ranges[k][0] + ranges[k][1] - start
            following.setdefault(key, (start, n, set()))[2].add(r)
        ranges = following
    return found


def _direct(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    grid = F.array(*[F.lit(p) for p in probs])
    row = df.agg(
        *[F.percentile(_value(c), grid).alias(f"q_{i}") for i, c in enumerate(columns)]
    ).first()
    empty = [None] * len(probs)
    return {c: list(row[f"q_{i}"] or empty) for i, c in enumerate(columns)}


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    direct_rows: int = DIRECT_ROWS,
    n_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated exact quantiles per column; all-missing columns give None.

    ``n_rows``, where the caller knows it, saves the counting pass on a table of moderate size.
    """
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    if n_rows is not None and n_rows <= direct_rows:
        return _direct(df, columns, probs)
    first = df.agg(
        *[F.count(_value(c)).alias(f"n_{i}") for i, c in enumerate(columns)]
    ).first()
    counts = {c: first[f"n_{i}"] for i, c in enumerate(columns)}
    if max(counts.values()) <= direct_rows:
        return _direct(df, columns, probs)

    wanted: dict[str, set[int]] = {}
    for c in columns:
        last = counts[c] - 1
        wanted[c] = (
            {r for p in probs for r in (math.floor(last * p), math.ceil(last * p))}
            if counts[c]
            else set()
        )
    at = _narrow(df, wanted, counts, direct_rows)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        values: list[float | None] = []
        for p in probs:
            if not counts[c]:
                values.append(None)
                continue
            place = (counts[c] - 1) * p
            low, high = math.floor(place), math.ceil(place)
            if low == high:
                values.append(at[(c, low)])
            else:
                values.append((high - place) * at[(c, low)] + (place - low) * at[(c, high)])
        result[c] = values
    return result


def approx_quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Sketch-based quantiles in one pass, for a quick look at a very large table."""
    grid = F.array(*[F.lit(p) for p in probs])
    row = df.agg(
        *[
            F.percentile_approx(_value(c), grid, accuracy).alias(f"q_{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    empty = [None] * len(probs)
    return {c: list(row[f"q_{i}"] or empty) for i, c in enumerate(columns)}
