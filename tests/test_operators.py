"""Invariants, brute-force comparisons and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sievework.catalog import base
from sievework.functions import scalars as S
from sievework.models import gnb, knn
from sievework.operators import (
    auc,
    charts,
    dedup,
    evaluate,
    impute,
    neighbors,
    order_stats,
    outliers,
    profile,
    project,
    running,
    sampling,
    scale,
    skew,
    smote,
)
from sievework.sources import scan, sink

SF = "/root/testdata/sf0.01"
X = base.FEATURES


# --- order statistics -----------------------------------------------------------------------


def test_histogram_search_equals_sorting(spark):
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=3000),
        "heavy": np.exp(rng.normal(scale=12, size=3000)),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000)),
        "constant": np.full(3000, 2.5),
        "wide": np.where(rng.random(3000) < 0.5, -1.7e308, 1.7e308),
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 1.0]
    found = order_stats.quantile_table(df, list(columns), probs, direct_rows=0)
    for c, values in columns.items():
        ordered = np.sort(values)
        for p, got in zip(probs, found[c]):
            place = (len(ordered) - 1) * p
            low, high = int(np.floor(place)), int(np.ceil(place))
            want = ordered[low] if low == high else (high - place) * ordered[low] + (place - low) * ordered[high]
            assert got == pytest.approx(want, rel=1e-12), (c, p)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    for direct in (0, 10):
        assert order_stats.quantile_table(df, ["x"], [0.5], direct)["x"] == [2.0]
    empty = spark.createDataFrame([(None,)], "x double")
    for direct in (-1, 10):
        assert order_stats.quantile_table(empty, ["x"], [0.5], direct)["x"] == [None]


# --- neighbours -----------------------------------------------------------------------------


def _points(n: int, seed: int):
    """Lattice points (many ties), one place with a third of all rows, and a spread-out part."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] = rng.normal(scale=30, size=(n // 2 - n // 3, 3))
    return x


def _brute(x, groups, k):
    out = {}
    for i in range(len(x)):
        d = (x - x[i]) ** 2
        d = d[:, 0] + d[:, 1] + d[:, 2]
        near = sorted((d[j], j) for j in range(len(x)) if j != i and groups[j] == groups[i])
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("cell_rows", [4096, 12])
def test_neighbours_equal_brute_force(spark, cell_rows):
    x = _points(420, 1)
    groups = [i % 2 for i in range(len(x))]
    rows = [(i, groups[i], *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, g int, x1 double, x2 double, x3 double")
    found: dict = {}
    for r in neighbors.knn_pairs(df, X, "id", 3, ["g"], cell_rows).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["d2"], r["neighbor"]))
    want = _brute(x, groups, 3)
    assert {i: [(d, j) for _, d, j in sorted(v)] for i, v in found.items()} == want


@pytest.mark.parametrize("cell_rows", [4096, 15])
def test_classifier_neighbours_equal_brute_force(spark, cell_rows):
    x = _points(300, 2)
    y = [int(abs(v[0])) % 3 for v in x]
    rows = [(i, y[i], *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, x1 double, x2 double, x3 double")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = {
        r["id"]: r["prediction"]
        for r in knn.classify(train, test, X, "label", "id", [0, 1, 2], 5, cell_rows=cell_rows).collect()
    }
    for i in range(0, 300, 4):
        d = (x - x[i]) ** 2
        d = d[:, 0] + d[:, 1] + d[:, 2]
        near = sorted((d[j], j) for j in range(300) if j % 4)[:5]
        votes = [sum(1 for _, j in near if y[j] == c) for c in range(3)]
        assert got[i] == votes.index(max(votes))


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "id long, x1 double, x2 double, x3 double")
    got = {r["id"]: [s["key"] for s in r["neighbors"]] for r in neighbors.knn_within_group(df, X, "id", 3).collect()}
    assert got == {1: [2], 2: [1]}


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 40).cast("int").alias("k"), "id"
    )
    lookup = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    salted = skew.salted_join(rows, lookup, ["k"], F.col("id"), hot_rows=100)
    plain = rows.join(lookup, "k")
    assert salted.count() == plain.count() == 3000
    assert salted.select(*plain.columns).exceptAll(plain).count() == 0


# --- split, folds, SMOTE --------------------------------------------------------------------


def _classes(spark, counts):
    rows = [(i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id long, label int")


def test_split_quotas_on_published_sizes(spark):
    df = _classes(spark, {0: 1226, 1: 88, 2: 15})
    split = sampling.stratified_split(df, "label", ["id"])
    counts = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {(0, 0): 981, (0, 1): 245, (1, 0): 70, (1, 1): 18, (2, 0): 12, (2, 1): 3}


def test_split_search_goes_through_several_rounds(spark, monkeypatch):
    df = _classes(spark, {0: 900, 1: 60})
    plain = {tuple(r) for r in sampling.stratified_split(df, "label", ["id"]).collect()}
    monkeypatch.setattr(sampling, "_FEW", 1)
    assert {tuple(r) for r in sampling.stratified_split(df, "label", ["id"]).collect()} == plain


def test_folds_are_even_and_complete(spark):
    df = _classes(spark, {0: 101, 1: 23, 2: 7})
    folded = sampling.stratified_kfold(df, "label", ["id"], 5)
    counts = {(r["label"], r["fold"]): r["count"] for r in folded.groupBy("label", "fold").count().collect()}
    assert sum(counts.values()) == 131 and folded.where("fold IS NULL").count() == 0
    for c in (0, 1, 2):
        per_fold = [counts.get((c, f), 0) for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1
    totals = [sum(counts.get((c, f), 0) for c in range(3)) for f in range(5)]
    assert max(totals) - min(totals) <= 1


def test_fewer_rows_than_folds_in_one_class(spark):
    folded = sampling.stratified_kfold(_classes(spark, {0: 20, 1: 3}), "label", ["id"], 5)
    assert folded.where("label = 1").groupBy("fold").count().where("count > 1").count() == 0


def test_numbers_are_dense_beyond_one_part(spark):
    df = _classes(spark, {0: 700, 1: 90})
    for total in (10, 40_000_000):
        numbered = sampling.dense_numbers(df, ["label"], ["id"], "smote", total).collect()
        for c, n in ((0, 700), (1, 90)):
            assert sorted(r["number"] for r in numbered if r["label"] == c) == list(range(n))
    one = sampling.dense_numbers(df, ["label"], ["id"], "smote", 10)
    many = sampling.dense_numbers(df, ["label"], ["id"], "smote", 40_000_000)
    assert one.exceptAll(many.select(*one.columns)).count() == 0


def test_smote_balances_and_interpolates(spark):
    rows = base.imb(spark, SF)
    out = smote.smote(rows, X, "label", "id").collect()
    originals = {(r["id"], r["label"], r["x1"], r["x2"], r["x3"]) for r in out if r["number"] is None}
    assert originals == {(r["id"], r["label"], r["x1"], r["x2"], r["x3"]) for r in rows.collect()}
    counts: dict = {}
    for r in out:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert len(set(counts.values())) == 1
    by_class: dict = {}
    for _, c, *x in originals:
        by_class.setdefault(c, []).append(x)
    for r in [r for r in out if r["number"] is not None][::40]:
        pts = np.array(by_class[r["label"]])
        p = np.array([r[x] for x in X])
        direct = np.linalg.norm(pts - p, axis=1)
        through = direct[:, None] + direct[None, :]
        apart = np.linalg.norm(pts[:, None] - pts[None, :], axis=2)
        # On a line between two rows of the class: the detour over the point is no detour.
        assert (np.abs(through - apart) < 1e-6).any()


def test_smote_is_the_same_with_small_cells(spark):
    rows = base.imb(spark, SF)
    a = smote.smote(rows, X, "label", "id")
    b = smote.smote(rows, X, "label", "id", cell_rows=8)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_smote_needs_more_rows_than_neighbours(spark):
    with pytest.raises(ValueError, match="needs more than 3"):
        smote.smote(base.imb(spark, "/root/testdata/sf0.001"), X, "label", "id")


def test_smote_of_a_balanced_table_changes_nothing(spark):
    df = _classes(spark, {0: 5, 1: 5}).withColumns({x: F.col("id").cast("double") for x in X})
    assert smote.smote(df, X, "label", "id").where("number IS NOT NULL").count() == 0


def test_resampling_stays_inside_the_training_folds(spark):
    folded = sampling.stratified_kfold(base.imb(spark, SF), "label", ["id"]).select("id", "label", "fold", *X)
    balanced = smote.smote_per_fold(folded, X, "label", "id", 5)
    left = folded.select("id", F.col("fold").alias("left_out"))
    assert balanced.where("id IS NOT NULL").join(left, ["id", "left_out"]).count() == 0


# --- models and evaluation ------------------------------------------------------------------


def test_gaussian_against_mllib(spark):
    rows = base.imb(spark, SF)
    model = gnb.fit(rows, X, "label")
    vectors = VectorAssembler(inputCols=X, outputCol="features").transform(rows)
    theirs = NaiveBayes(modelType="gaussian").fit(vectors.withColumn("label", F.col("label").cast("double")))
    assert np.allclose(theirs.theta.toArray(), np.array(model.means))
    assert np.allclose(theirs.sigma.toArray(), np.array(model.smoothed()))
    # Scores add up to one.
    total = sum((F.col(f"score_{i}") for i in range(1, 4)), F.col("score_0"))
    sums = gnb.predict(rows, model, proba=True).select(F.min(total).alias("lo"), F.max(total).alias("hi")).first()
    assert sums["lo"] == pytest.approx(1) and sums["hi"] == pytest.approx(1)


def test_weighted_metrics_against_mllib(spark):
    rows = base.pred(spark, SF).select(
        F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")
    )
    ours = evaluate.weighted_prf(rows, "label", "prediction").first()
    names = {"precision_w": "weightedPrecision", "recall_w": "weightedRecall", "f1": "weightedFMeasure"}
    for name, theirs in names.items():
        assert ours[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(rows))


def _binary(spark):
    rows = base.pred(spark, SF)
    return rows.select(
        (F.col("label") == 2).cast("double").alias("label"),
        (F.floor(F.col("u") * 30) / 30).alias("score_1"),
    ).withColumn("score_0", -F.col("score_1"))


def test_auc_against_mllib(spark):
    rows = _binary(spark)
    ours = auc.roc_auc_ovr(rows, "label", {0.0: "score_0", 1.0: "score_1"}).first()["roc_auc"]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score_1").evaluate(rows)
    assert ours == pytest.approx(theirs)
    flipped = auc.roc_auc_ovr(rows, "label", {0.0: "score_1", 1.0: "score_0"}).first()["roc_auc"]
    assert flipped == pytest.approx(1 - ours)


def test_auc_by_ranges_equals_direct(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("label"),
        *[(F.hash("id", F.lit(c)) % 997).cast("double").alias(f"s{c}") for c in range(3)],
    )
    scores = {c: f"s{c}" for c in range(3)}
    direct = auc.roc_auc_ovr(rows, "label", scores).first()["roc_auc"]
    ranged = auc.roc_auc_ovr(rows, "label", scores, direct_rows=0).first()["roc_auc"]
    assert direct == pytest.approx(ranged, rel=1e-12)


def test_auc_is_null_when_a_class_is_missing(spark):
    rows = _binary(spark).where("label = 0")
    assert auc.roc_auc_ovr(rows, "label", {0.0: "score_0", 1.0: "score_1"}).first()["roc_auc"] is None


def test_running_total_by_ranges(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).cast("double").alias("x"), (F.col("id") % 5).alias("v"))
    a = running.total_before(df, [], "x", "v", "t", 4000, direct_rows=10_000)
    b = running.total_before(df, [], "x", "v", "t", 4000, direct_rows=0)
    assert a.exceptAll(b.select(*a.columns)).count() == 0


# --- cleaning edge cases --------------------------------------------------------------------


def test_title_case(spark):
    words = ["laki-laki", "they're", "SEVERELY stunted", "", "ab1cd éa", "x"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(S.title_case("w")).collect()]
    assert got == [w.title() for w in words]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(S.clip("x", 0.0, 1.0)).collect()] == [None, 1.0, 0.0]


def test_impute_leaves_nothing_missing(spark):
    rows = [(1, None, "b", None), (2, float("nan"), None, 3), (3, 4.0, "a", 4), (4, 8.0, "b", 4), (5, 6.0, "a", 9)]
    df = spark.createDataFrame(rows, "id long, x double, s string, n int")
    filled = impute.impute(df)
    assert profile.missing_total(filled).first()[0] == 0
    first = filled.where("id = 1").first()
    assert (first["x"], first["s"], first["n"]) == (6.0, "b", 4.0)
    assert filled.where("id = 2").first()["s"] == "a"  # tie: the smaller value
    assert filled.columns == ["id", "x", "s", "n", "x_was_missing", "n_was_missing"]
    assert impute.impute(df, add_indicator=False).columns == df.columns


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert impute.impute(df).where("x IS NULL").count() == 2
    with pytest.raises(ValueError):
        outliers.fit_fences(df, ["x"])


def test_capping_leaves_no_outlier(spark):
    df = base.obs(spark, SF)
    report = outliers.capping_report(df, outliers.fit_fences(df, ["price"])).first()
    assert report["n_before"] > 0 and report["n_after"] == 0


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert outliers.zscore_table(df, ["x"]).first()["n_zscore"] == 0
    scaled = scale.apply_scaler(df, scale.fit_scaler(df, ["x"]))
    assert [r["x"] for r in scaled.collect()] == [0.0, 0.0]


def test_scaled_training_rows_are_standard(spark):
    df = base.imb(spark, SF)
    scaled = scale.apply_scaler(df, scale.fit_scaler(df, X))
    for r in profile.moments(scaled, X).collect():
        assert r["mean"] == pytest.approx(0, abs=1e-9) and r["std_pop"] == pytest.approx(1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, label int, s string, x1 double, x2 double, x3 double")
    assert dedup.duplicate_count(df).first()[0] == 0
    assert profile.missing_total(df).first()[0] == 0
    assert profile.distribution_table(df, "s").count() == 0
    assert evaluate.weighted_prf(df.withColumn("p", F.col("label")), "label", "p").first()["f1"] == 0
    assert sampling.stratified_split(df, "label", ["id"]).count() == 0
    assert smote.smote(df, X, "label", "id").count() == 0
    assert neighbors.knn_pairs(df, X, "id", 3).count() == 0


def test_names_must_not_collide(spark):
    with pytest.raises(ValueError, match="collide"):
        project.standardize_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int"))


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1)], "s string, n int")
    assert dedup.duplicate_count(df).first()[0] == 1
    assert dedup.drop_duplicates(df).count() == 2


# --- every size, every value -------------------------------------------------------------------


@pytest.mark.parametrize("direct", [order_stats.DIRECT_ROWS, 50, 1])
def test_quantiles_with_infinities_heavy_tails_ties_and_nan(spark, direct):
    values = [float("inf")] * 3 + [float("-inf")] * 2 + [10.0**e for e in range(-300, 301, 3)]
    values += [7.0] * 150 + [float("nan"), None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    present = sorted(v for v in values if v is not None and v == v)
    ranks = [0, 1, 4, 5, 100, 180, 250, len(present) - 4, len(present) - 1]
    probs = [r / (len(present) - 1) for r in ranks]
    found = order_stats.quantile_table(df, ["x"], probs, direct_rows=direct)["x"]
    for r, v in zip(ranks, found):
        near = present[max(0, r - 1) : r + 2]
        assert near[0] <= v <= near[-1]


@pytest.mark.parametrize("values", [[float("inf")], list(range(400)), [1e-304, 1e300] * 200])
def test_narrowing_ends_in_few_passes(spark, values, monkeypatch):
    rows = [float(v) for v in range(3000)] + [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in rows], "x double")
    passes = []
    plain = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: passes.append(1) or plain(self, *a))
    found = order_stats._narrow(df, {"x": set(range(0, len(rows), 97))}, {"x": len(rows)}, direct_rows=20)
    assert found == {("x", r): sorted(rows)[r] for r in range(0, len(rows), 97)}
    assert len(passes) <= 6


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_auc_is_null_when_a_score_is_missing(spark, bad, direct):
    rows = [(0, 0.1), (1, 0.9), (0, 0.4), (1, 0.3), (1, bad)]
    df = spark.createDataFrame([(y, s, None if s is None else 1 - s) for y, s in rows], "y int, one double, zero double")
    names = {0: "zero", 1: "one"}
    assert auc.roc_auc_ovr(df, "y", names, direct).first()["roc_auc"] is None
    whole = df.where("one IS NOT NULL AND NOT isnan(one)")
    assert auc.roc_auc_ovr(whole, "y", names, direct).first()["roc_auc"] == 0.75


def test_running_total_places_null_first_and_nan_last(spark):
    rows = [(None, 5), (float("nan"), 7), (2.0, 1), (1.0, 3)]
    df = spark.createDataFrame(rows, "x double, v long")
    for direct in (0, 100):
        got = {str(r.x): r.t for r in running.total_before(df, [], "x", "v", "t", 4, direct).collect()}
        assert got == {"None": 0, "1.0": 5, "2.0": 8, "nan": 9}


def test_many_classes_split_and_fold_exactly(spark):
    df = spark.range(20_000).selectExpr("id", "CAST(id % 5000 AS STRING) AS label")
    split = sampling.stratified_split(df, "label", ["id"]).cache()
    assert split.where("is_test = 1").count() == 4_000
    per = split.groupBy("label").agg({"is_test": "sum"}).collect()
    assert len(per) == 5000 and {r[1] for r in per} <= {0, 1}
    folds = sampling.stratified_kfold(df, "label", ["id"], k=4)
    sizes = folds.groupBy("label", "fold").count().collect()
    assert len(sizes) == 20_000 and {r["count"] for r in sizes} == {1}
    missing = df.selectExpr("id", "CASE WHEN id > 5 THEN label END AS label")
    for make in (sampling.stratified_split, sampling.stratified_kfold):
        with pytest.raises(ValueError, match="miss the class label"):
            make(missing, "label", ["id"])


def test_nan_is_no_outlier_and_stays(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 500]] + [(nan,), (None,)], "x double")
    fences = outliers.fit_fences(df, ["x"])
    assert outliers.fence_table(df, fences).first()["n_iqr"] == 1
    assert outliers.zscore_table(df, ["x"]).first()["n_zscore"] == 1
    capped = [r.x for r in outliers.cap_to_fences(df, fences).collect()]
    assert sum(x is not None and x != x for x in capped) == 1 and capped.count(None) == 1
    box = charts.boxplot_stats(df, fences).first()
    assert (box["whisker_high"], box["n_outliers"]) == (19.0, 1)


def test_groups_and_labels_that_only_look_alike(spark):
    rows = [("a|b", "c", 0.0, 1), ("a", "b|c", 0.1, 2), ("a|b", "c", 5.0, 3), ("a", "b|c", 5.1, 4), (None, "", 0.0, 5), ("", None, 0.1, 6)]
    df = spark.createDataFrame(rows, "g string, h string, x double, id long")
    found = neighbors.neighbor_lists(df, df, ["x"], "id", 2, group=["g", "h"]).collect()
    ids = sorted(sorted(n["key"] for n in r["neighbors"]) for r in found)
    assert ids == [[1, 3], [1, 3], [2, 4], [2, 4], [5], [6]]
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "b|c")], "y string, p string")
    matrix = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(pairs, "y", "p").collect()}
    assert matrix["a|b", "c"] == 1 and matrix["a", "b|c"] == 2 and sum(matrix.values()) == 3


def test_text_with_line_breaks_and_backslashes_comes_back(spark, tmp_path):
    texts = ["a\nb", "c\\nd", "e\r\nf\\", "\\\\n", 'q"u\n"o', "plain", "\\x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    sink.write_delimited(df, f"{tmp_path}/escaped")
    found = scan.scan_delimited(spark, f"{tmp_path}/escaped", df.schema, sep=",", missing=[""])
    assert {r.id: r.t for r in found.collect()} == dict(enumerate(texts))
    sink.write_delimited(df, f"{tmp_path}/plain", escape_breaks=False)
    found = scan.scan_delimited(
        spark, f"{tmp_path}/plain", df.schema, sep=",", missing=[""], escaped_breaks=False, multi_line=True
    )
    assert {r.id: r.t for r in found.collect()} == dict(enumerate(texts))


def test_accuracy_counts_a_missing_prediction_as_wrong(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (1, None), (0, 1)], "y int, p int")
    both = evaluate.accuracy(rows, "y", "p").first()["accuracy"], evaluate.trace_accuracy(
        evaluate.confusion_counts(rows, "y", "p")
    ).first()["share"]
    assert both == (0.5, 0.5)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_a_missing_feature_has_no_neighbours(spark, bad):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, bad)], "id long, x double")
    with pytest.raises(Exception, match="feature x is missing"):
        neighbors.knn_pairs(df, ["x"], "id", 1).collect()


def test_range_descent_finds_the_cells_and_compares_few_boxes():
    rng = np.random.default_rng(5)
    points = rng.random((40_000, 3))
    tree = neighbors._grow(points, 1024, 0)
    cell = neighbors._locate(tree, points)
    order = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[order], return_index=True)
    parts = np.split(points[order], first[1:])
    lo, hi = (np.array([f(p, axis=0) for p in parts]) for f in (np.min, np.max))
    tree = tree.filled(cells, np.array([len(p) for p in parts]), lo, hi)
    asked, limit = points[:300], np.full(300, 0.03**2)
    rows, found, compared = neighbors._cells_within(tree, asked, limit)
    gap = np.maximum(np.maximum(lo[None] - asked[:, None], asked[:, None] - hi[None]), 0)
    want = {(i, int(cells[j])) for i, j in zip(*np.nonzero((gap**2).sum(2) <= limit[:, None]))}
    assert set(zip(rows.tolist(), found.tolist())) == want
    assert compared < 0.15 * 300 * len(cells)
    far = neighbors._limits(tree, asked, 5)
    for p, d in zip(asked[:50], far):
        assert (((points - p) ** 2).sum(1) <= d).sum() >= 5
