"""Splits and folds by class tables against the marked ones; sketches against all ranks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.operators import running, sampling, sketches


@pytest.fixture
def rows(spark):
    """600 rows: a class with a third of them, many of equal size, string labels in no natural order."""
    label = F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("c"), ((F.col("id") * 7) % 61).cast("string")))
    return spark.range(600).select("id", label.alias("label"), F.lit("x").alias("_n"))


def test_same_rows_as_the_marked_split(rows):
    few = sampling.stratified_split(rows, "label", ["id"], 0.23)
    many = sampling.stratified_split(rows, "label", ["id"], 0.23, most_classes=5)
    assert many.columns == few.columns and sorted(many.collect()) == sorted(few.collect())


@pytest.mark.parametrize("k", [2, 5, 7])
def test_same_rows_as_the_marked_folds(rows, k):
    few = sampling.stratified_kfold(rows, "label", ["id"], k)
    many = sampling.stratified_kfold(rows, "label", ["id"], k, most_classes=5)
    assert many.columns == few.columns and sorted(many.collect()) == sorted(few.collect())


def test_odd_classes(spark, rows):
    lone = rows.unionByName(spark.createDataFrame([(1000, "lone", "x")], rows.schema))
    with pytest.raises(ValueError, match="at least two rows"):
        sampling.stratified_split(lone, "label", ["id"], most_classes=5)
    missing = rows.unionByName(spark.createDataFrame([(1000, None, "x")], "id long, label string, _n string"))
    with pytest.raises(ValueError, match="1 rows miss"):
        sampling.stratified_split(missing, "label", ["id"], most_classes=5)
    with pytest.raises(ValueError, match="with at least 201 rows"):
        sampling.stratified_kfold(rows, "label", ["id"], 201, most_classes=5)
    assert sampling.stratified_split(rows.limit(0), "label", ["id"]).count() == 0


def test_running_total_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.t for r in running.total_before_all(df.repartition(7), "k", "v", "t").collect()}
    total = 0
    for k, v in sorted((i * 37 % 1009, i % 5) for i in range(1000)):
        assert got[k] == total
        total += v


def test_sketches_of_batches_merge(spark):
    value = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 7001)
    df = spark.range(50_000).select((F.col("id") % 3).alias("g"), value.cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    batches = [sketches.sketch_table(df.where(F.hash("x") % 4 == F.lit(r)), ["x", "none"], ["g"]) for r in (-3, -2, -1, 0, 1, 2, 3)]
    merged = sketches.merge(batches, ["g"])
    found = sketches.quantiles(merged, [0, 0.1, 0.5, 0.99, 1])
    errors = sketches.rank_errors(df, found, "x", ["g"]).collect()
    assert len(errors) == 15 and all(r.error <= sketches.rank_bound() for r in errors)
    exact = {r.g: (r.n, r.lo, r.hi) for r in df.where("x = x AND NOT isnan(x)").groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    ends = {(r.g, r.prob): (r.n, r.value) for r in errors}
    assert all(ends[g, 0.0] == (n, lo) and ends[g, 1.0] == (n, hi) for g, (n, lo, hi) in exact.items())
    whole = sketches.quantiles(sketches.sketch_table(df, ["x"]), [0.5])
    assert sketches.rank_errors(df, whole, "x").first().error <= sketches.rank_bound()
    assert sketches.sketch_table(df.limit(0), ["x"], ["g"]).count() == 0
