"""Profiling: counts, shares, descriptions, missing cells, moments, before/after tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import order_stats
from sievework.operators.project import missing, nan_as_null, numeric_columns
from sievework.session import materialize


def value_counts(df: DataFrame, column: str, by_key: bool = False) -> DataFrame:
    """(column, n) without missing values, most frequent first or in key order."""
    counts = (
        nan_as_null(df.select(column))
        .where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(column) if by_key else counts.orderBy(F.desc("n"), column)


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column, by_key=True)


def value_shares(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """(column, pct) of the non-missing values.

    The total is a scalar subquery, not a window over all groups, so a column with many
    distinct values is not pulled into one task.
    """
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    share = F.bround(F.try_divide(F.col("n") * F.lit(100.0), total), digits)
    return counts.select(column, share.alias("pct")).orderBy(F.desc("pct"), column)


def distribution_table(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """(column, n, pct) where pct is the share of the non-missing rows."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    share = F.bround(F.try_divide(F.col("n") * F.lit(100.0), total), digits)
    return counts.select(column, "n", share.alias("pct")).orderBy(F.desc("n"), column)


def distinct_values(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    values = df.select(column).distinct()
    return values.orderBy(column) if ordered else values


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, mean, population std, sample std, min, max; one pass."""
    rows = nan_as_null(df.select(*columns))
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("std_pop"),
                F.stddev_samp(x).alias("std_samp"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> DataFrame:
    """(column_name, prob, value), linear interpolation between neighbouring ranks."""
    pick = order_stats.quantile_table if exact else order_stats.approx_quantile_table
    table = pick(df, columns, probs)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, table[c])]
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")


def median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantiles(df, columns, [0.5]).select("column_name", F.col("value").alias("median"))


#: Texts of up to so many bytes are counted by themselves, longer ones by their digest.
SHORT_BYTES = 32


def _count_key(column: str) -> Column:
    """What a value is counted by: never more than a few dozen bytes, however long the text."""
    value = F.col(column).cast("string")
    short = F.octet_length(value) <= SHORT_BYTES
    return F.when(short, F.concat(F.lit("="), value)).otherwise(F.concat(F.lit("#"), F.md5(value)))


def _keyed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, key, n) of the values that are not missing; no text is shuffled."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), _count_key(c)).alias("key"))
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("key").isNotNull())
        .groupBy("column_name", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def text_description(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, n_unique, top, freq); the smallest value wins a tie for top.

    Counting per value comes first, keyed by a digest where values are long, so the per-column step only sees
    one short row per value and combines map-side. Long texts themselves are looked at again only for the
    least of those that tie; where no value of a column occurs twice that is a minimum over the rows.
    """
    spark = df.sparkSession
    counts = materialize(_keyed_counts(df, columns), "value-counts")
    facts = counts.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("freq")
    )
    facts = {r["column_name"]: r for r in facts.collect()}  # a row per column
    schema = "column_name string, n long, n_unique long, top string, freq long"
    if not facts:
        return spark.createDataFrame([], schema)
    most = spark.createDataFrame([(c, r["freq"]) for c, r in facts.items()], "column_name string, n long")
    tied = counts.join(most, ["column_name", "n"])
    is_short = F.col("key").startswith("=")
    least = tied.groupBy("column_name").agg(
        F.min(F.when(is_short, F.substring("key", 2, SHORT_BYTES))).alias("top"), F.count_if(~is_short).alias("long")
    )
    least = {r["column_name"]: r for r in least.collect()}
    found: dict[str, list[str]] = {c: [r["top"]] for c, r in least.items() if r["top"] is not None}

    def cells(names: Sequence[str]) -> DataFrame:
        of = lambda c: F.struct(F.lit(c).alias("column_name"), _count_key(c).alias("key"), F.col(c).cast("string").alias("value"))
        return df.select(F.inline(F.array(*[of(c) for c in names]))).where(F.col("key").startswith("#"))

    again = [c for c, r in least.items() if r["long"]]
    once, many = [c for c in again if facts[c]["freq"] == 1], [c for c in again if facts[c]["freq"] > 1]
    longs = []
    if once:
        longs.append(cells(once))
    if many:
        longs.append(cells(many).join(tied.where(~is_short).select("column_name", "key"), ["column_name", "key"], "left_semi"))
    for some in longs:
        for r in some.groupBy("column_name").agg(F.min("value").alias("top")).collect():
            found.setdefault(r["column_name"], []).append(r["top"])
    # Spark orders text by its bytes.
    rows = [(c, r["n"], r["n_unique"], min(found[c], key=lambda t: t.encode()), r["freq"]) for c, r in facts.items()]
    return spark.createDataFrame(rows, schema)


def mode_smallest(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the smallest one on ties, and its count."""
    counts = value_counts(df, column)
    return counts.orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("mode"), "n")


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2
) -> DataFrame:
    """Wide description: ``statistic`` plus one column per input, rounded half-even."""
    columns = list(columns or numeric_columns(df))
    stats = {r["column_name"]: r for r in moments(df, columns).collect()}
    quart = order_stats.quantile_table(df, columns, [0.25, 0.5, 0.75])
    rows = [
        ("count", *[float(stats[c]["n"]) for c in columns]),
        ("mean", *[stats[c]["mean"] for c in columns]),
        ("std", *[stats[c]["std_samp"] for c in columns]),
        ("min", *[stats[c]["min"] for c in columns]),
        ("25%", *[quart[c][0] for c in columns]),
        ("50%", *[quart[c][1] for c in columns]),
        ("75%", *[quart[c][2] for c in columns]),
        ("max", *[stats[c]["max"] for c in columns]),
    ]
    schema = T.StructType(
        [T.StructField("statistic", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in columns]
    )
    table = df.sparkSession.createDataFrame(rows, schema)
    return table.select("statistic", *[F.bround(c, digits).alias(c) for c in columns])


def describe_all(df: DataFrame, digits: int = 2) -> DataFrame:
    """Description of text and numeric columns together, cells as text, NULL where not defined."""
    numeric = numeric_columns(df)
    other = [c for c in df.columns if c not in numeric]
    text = {r["column_name"]: r for r in text_description(df, other).collect()} if other else {}
    number = (
        {r["statistic"]: r for r in describe_numeric(df, numeric, digits).collect()} if numeric else {}
    )

    def cell(statistic: str, c: str) -> str | None:
        if c in numeric:
            value = number[statistic][c] if statistic in number else None
            return None if value is None else f"{value:.{digits}f}"
        row = text.get(c)
        if row is None:
            return "0" if statistic in ("count", "unique") else None
        return {
            "count": str(row["n"]),
            "unique": str(row["n_unique"]),
            "top": row["top"],
            "freq": str(row["freq"]),
        }.get(statistic)

    names = ["count", "unique", "top", "freq", "mean", "std", "min", "25%", "50%", "75%", "max"]
    rows = [(s, *[cell(s, c) for c in df.columns]) for s in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ["statistic", *df.columns]])
    return df.sparkSession.createDataFrame(rows, schema)


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, n_rows) for every column, in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.count_if(missing(df, c)).alias("n_missing"))
            for c in df.columns
        ]
    )
    one = df.agg(cells.alias("cells"), F.count(F.lit(1)).alias("n_rows"))
    return one.select(F.inline("cells"), "n_rows")


def missing_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """(column_name, n_missing, pct_missing) of the columns that miss anything."""
    pct = F.bround(F.try_divide(F.col("n_missing") * F.lit(100.0), F.col("n_rows")), digits)
    return (
        missing_counts(df)
        .where(F.col("n_missing") > 0)
        .select("column_name", "n_missing", pct.alias("pct_missing"))
    )


def missing_total(df: DataFrame) -> DataFrame:
    cells = reduce(lambda a, b: a + b, [missing(df, c).cast("int") for c in df.columns])
    return df.agg(F.coalesce(F.sum(cells.cast("long")), F.lit(0)).alias("n_missing"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson_r"))


def before_after(before: DataFrame, after: DataFrame, duplicates: int) -> DataFrame:
    """(aspect, before, after): rows, columns, missing cells, duplicates removed."""

    def facts(df: DataFrame, name: str, removed: int | None) -> DataFrame:
        cells = reduce(lambda a, b: a + b, [missing(df, c).cast("int") for c in df.columns])
        one = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(cells.cast("long")), F.lit(0)).alias("missing"),
        )
        pairs = F.array(
            F.struct(F.lit("rows").alias("aspect"), F.col("rows").alias(name)),
            F.struct(F.lit("columns").alias("aspect"), F.lit(len(df.columns)).cast("long").alias(name)),
            F.struct(F.lit("missing").alias("aspect"), F.col("missing").alias(name)),
            F.struct(
                F.lit("duplicates_removed").alias("aspect"),
                F.lit(removed).cast("long").alias(name),
            ),
        )
        return one.select(F.inline(pairs))

    return facts(before, "before", None).join(facts(after, "after", duplicates), "aspect")


def best_by_metric(df: DataFrame, metric: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Whole row with the highest metric (per group); the first name wins a tie."""
    rest = [c for c in df.columns if c not in (metric, name)]
    lead = F.struct((-F.col(metric)).alias("_neg"), F.col(name).alias(name), metric, *rest)
    best = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min(lead).alias("best"))
    return best.select(*[F.col(f"best.{c}").alias(c) for c in df.columns])


def argmin_by(df: DataFrame, label: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Label of the smallest value (per group); the smallest label wins a tie."""
    least = F.min(F.struct(F.col(value).alias("v"), F.col(label).alias("l")))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(least.alias("least"))
        .select(*by, F.col("least.l").alias(label), F.col("least.v").alias(value))
    )
