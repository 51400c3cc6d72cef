"""Forests by cells of rows, and runs that fill the executors on their own."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.sql import functions as F

from sievework.models import forest, mllib, registry
from sievework.plans import comparison

X = ("a", "b", "c")


def _rows(spark, n=600, first=0):
    rng = np.random.default_rng(first + 5)
    a, b, c = rng.normal(size=n), rng.integers(0, 30, n).astype(float), rng.integers(0, 2, n).astype(float)
    label = ((a > 0.3).astype(int) + (b > 12) * (c > 0)).astype(int)
    label = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), label)
    rows = [(first + i, int(y), *map(float, v)) for i, (y, *v) in enumerate(zip(label, a, b, c))]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double")


def _gini(y, w):
    n = w.sum()
    return sum(w[y == k].sum() ** 2 for k in np.unique(y)) / n if n else 0.0


def test_best_splits_against_all_splits():
    rng = np.random.default_rng(2)
    node, bins = np.sort(rng.integers(0, 5, 200)), rng.integers(0, 9, (200, 3))
    label, weight = rng.integers(0, 3, 200), rng.integers(1, 4, 200).astype(float)
    total = np.bincount(node * 3 + label, weight, 15).reshape(5, 3)
    tried = np.array([[1, 1, 0], [0, 1, 1], [1, 0, 1], [1, 1, 1], [0, 0, 0]], bool)
    feature, at = forest.best_splits(node, bins, label, weight, total, tried)
    assert feature[4] == -1
    for k in range(4):
        y, w, x = label[node == k], weight[node == k], bins[node == k]
        scores = {
            (f, b): _gini(y[x[:, f] <= b], w[x[:, f] <= b]) + _gini(y[x[:, f] > b], w[x[:, f] > b])
            for f in range(3) if tried[k, f] for b in np.unique(x[:, f])[:-1]
        }
        assert scores[feature[k], at[k]] == pytest.approx(max(scores.values()))


def test_a_full_tree_parts_all_cells_that_can_be_parted():
    rng = np.random.default_rng(3)
    bins = np.array([(i, j) for i in range(20) for j in range(20)])
    label = rng.integers(0, 3, len(bins))
    tree = forest.grow_tree(bins, label, np.full(len(bins), 50), 3, 2, (1, 2))
    assert (forest.walk(tree, bins).argmax(axis=1) == label).mean() > 0.95
    split, _, left, counts = tree
    inner = split >= 0
    assert np.allclose(counts[inner], counts[left[inner]] + counts[left[inner] + 1])


def test_a_forest_of_many_rows_is_grown_by_cells(spark, monkeypatch):
    """It guesses about as well as MLlib's, and the same whatever the partitions are."""
    train, test = _rows(spark, 1500), _rows(spark, 500, 10_000)
    hits = []
    for many in (10**9, 0):
        monkeypatch.setattr(mllib, "MANY_ROWS", many)
        model = mllib.fit_random_forest(train, X, "label", 3, 20)
        assert isinstance(model, forest.Forest) == (many == 0)
        out = model.predict(test)
        assert out.columns == [*test.columns, "prediction", "score_0", "score_1", "score_2"] and out.count() == 500
        assert out.where(F.abs(F.col("score_0") + F.col("score_1") + F.col("score_2") - 1) > 1e-9).count() == 0
        hits.append(out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    assert hits[1] > 0.75 and abs(hits[0] - hits[1]) < 0.06
    again = mllib.fit_random_forest(train.repartition(7), X, "label", 3, 20).predict(test.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_all_rows_count(spark, monkeypatch):
    """A tree's sample is as large as the table, up to chance; more cells than allowed are left to MLlib."""
    found = forest.fit_forest(_rows(spark), X, "label", 3, 40)
    sizes = [np.frombuffer(r["counts"])[:3].sum() for r in found.trees.select("counts").collect()]
    assert len(set(sizes)) > 10 and np.mean(sizes) == pytest.approx(600, abs=20)
    monkeypatch.setattr(forest, "MAX_CELLS", 10)
    assert forest.fit_forest(_rows(spark), X, "label", 3, 2) is None


def test_labels_out_of_range_raise(spark):
    with pytest.raises(ValueError, match="labels"):
        forest.fit_forest(_rows(spark), X, "label", 2, 2)


def test_missing_values_raise(spark):
    train = _rows(spark)
    broken = train.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(ValueError, match="missing"):
        forest.fit_forest(broken, X, "label", 3, 2)
    with pytest.raises(Exception, match="missing"):
        forest.fit_forest(train, X, "label", 3, 2).predict(broken).collect()


def test_large_runs_go_one_at_a_time(spark, monkeypatch):
    """A run of many rows has the executors' memory for itself."""
    under_way, most, lock = [0], [0], threading.Lock()
    gauss = registry.gaussian_spec()

    def fit(rows, problem):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        found = gauss.fit(rows, problem)
        threading.Event().wait(1)
        with lock:
            under_way[0] -= 1
        return found

    problem = registry.Problem(X, "label", "id", 3)
    specs = [registry.ModelSpec(f"m{i}", fit) for i in range(3)]
    for many, wanted in ((0, 1), (10**9, 3)):
        most[0] = 0
        monkeypatch.setattr(comparison, "MANY_ROWS", many)
        rows = comparison.compare_models(_rows(spark), _rows(spark, 100, 10_000), problem, specs).collect()
        assert len(rows) == 6 and all(r["f1"] is not None for r in rows)
        assert most[0] == 1 if wanted == 1 else most[0] > 1


def test_classes_fitted_in_turn_keep_no_rows_twice(spark, monkeypatch):
    """The machine of many rows is that of few rows, and no table is cached for it."""
    train, test = _rows(spark, 300).coalesce(1), _rows(spark, 200, 10_000).coalesce(1)
    found, kept = [], []
    persist = type(train).persist
    monkeypatch.setattr(type(train), "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    for fit in (mllib._fit, mllib._fit_in_turn):
        kept.clear()
        inner = LinearSVC(regParam=0.01, maxIter=5, standardization=False)
        ovr = OneVsRest(classifier=inner, rawPredictionCol="rawPrediction", parallelism=3)
        model = fit(ovr, train, X, "label", 3, "margin")
        assert bool(kept) == (fit is mllib._fit)
        found.append({r["id"]: r for r in model.predict(test).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 200
    assert all(found[0][i]["prediction"] == found[1][i]["prediction"] for i in found[0])
    assert max(abs(found[0][i][f"score_{c}"] - found[1][i][f"score_{c}"]) for i in found[0] for c in range(3)) < 1e-6


def test_many_rows_are_fitted_in_turn(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(mllib, "_fit_in_turn", lambda *a: asked.append(a))
    monkeypatch.setattr(mllib, "MANY_ROWS", 0)
    mllib.fit_svm_rff(_rows(spark), X, "label", 3)
    assert len(asked) == 1
