"""Physical plans, text files, workflows, models, streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework import catalog
from sievework.catalog import base, learn
from sievework.functions import scalars as S
from sievework.models import gnb, registry
from sievework.operators import impute, outliers, scale, smote
from sievework.plans import cleaning, comparison, search
from sievework.session import scratch_path, scratch_root
from sievework.sources import scan, sink

SF = "/root/testdata/sf0.01"
X = base.FEATURES

# These look for neighbours or walk boosted trees with numpy inside tasks; everything else stays in the JVM.
USES_PYTHON = {
    "knn_within_class", "smote_oversample", "smote_per_fold", "resample_effect", "knn_classify", "knn_scores",
    "model_facts", "knn_projected", "scan_quoted_breaks",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - USES_PYTHON))
def test_no_python_and_no_cross_product(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert node not in plan, node


def test_only_needed_columns_are_read(spark):
    plan = _plan(catalog.QUERIES["chart_scatter_bins"](spark, SF))
    assert "l_shipdate" not in plan and "l_comment" not in plan
    plan = _plan(catalog.QUERIES["lookup_default"](spark, SF))
    assert "o_totalprice" not in plan


def test_apply_steps_move_no_rows(spark):
    """Filling, capping, scaling and predicting are projections; marking a split joins a row per class."""
    rows = base.obs(spark, SF)
    imputed = impute.apply_imputer(rows, impute.fit_imputer(rows, ["price", "sex"]))
    capped = outliers.cap_to_fences(imputed, outliers.fit_fences(rows, ["price"]))
    assert "Exchange" not in _plan(capped)
    split = catalog.QUERIES["stratified_split_large"](spark, SF)
    assert "Exchange" not in _plan(split).replace("BroadcastExchange", "") and "Window" not in _plan(split)


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_delimited_corner_cases(spark):
    path = scratch_path(spark, "corner")
    rows = [
        (" Stunted", 1.5, "{'a': 1, 'b': 2}"),
        ('say "x"', None, None),
        ("two  ", 2.0, "a;b,c"),
    ]
    schema = T.StructType(
        [T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("p", T.StringType())]
    )
    df = spark.createDataFrame(rows, schema)
    sink.write_delimited(df, path)
    back = {tuple(r) for r in scan.scan_delimited(spark, path, schema, sep=",", missing=[]).collect()}
    assert back == {tuple(r) for r in rows}


def test_bad_numbers_are_missing_cells(spark):
    path = scratch_path(spark, "bad")
    text = spark.createDataFrame([("1", "a"), ("x", "b"), ("n/a", "NaN")], "n string, s string")
    sink.write_delimited(text, path, sep=";")
    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType())])
    got = {tuple(r) for r in scan.scan_delimited(spark, path, schema).collect()}
    assert got == {(1.0, "a"), (None, "b"), (None, None)}


def test_absent_table(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    path = scratch_path(spark, "absent")
    assert scan.scan_optional(spark, path, schema) is None
    assert scan.scan_optional_or_empty(spark, path, schema).count() == 0


def test_cleaning_run(spark):
    raw = base.obs(spark, SF).drop("row_key")
    result = cleaning.clean(raw, ["status"], {"sex": S.SEX_NAMES}, ["qty_raw", "price"], "obs")
    assert set(result.stages) == set(sink.STAGES)
    summary = result.summary.first()
    assert summary["rows_before"] == 60_000
    assert summary["rows_after"] == 60_000 - summary["duplicates"] == result.clean.count()
    assert {r["status"] for r in result.clean.select("status").distinct().collect()} == set(S.STATUS_CODES)
    path = scratch_path(spark, "summary")
    sink.write_text(sink.summary_lines(result.summary), path)
    assert spark.read.text(path).first()[0] == "Dataset: obs"


def test_report_names(spark):
    df = sink.to_report_names(spark.createDataFrame([("a", 1.0)], "model string, f1 double"))
    assert df.columns == ["Model", "F1-Score"]


def test_models_learn_something(spark):
    """Quick versions of the fitted models beat or match always naming the largest class."""
    train, test = learn._train_test(spark, SF)
    problem = learn.PROBLEM
    fit = scale.fit_scaler(train, X)
    for spec in registry.default_registry(trees=5, rounds=2):
        if spec.name in ("Boosted Trees Preset", "SVM (Fourier features)"):
            continue
        a, b = (scale.apply_scaler(train, fit), scale.apply_scaler(test, fit)) if spec.use_scaling else (train, test)
        out = spec.fit(a, problem).predict(b)
        assert {"prediction", "score_0", "score_3"} <= set(out.columns)
        assert out.count() == 80
        hit = out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert hit > 0.1, spec.name


def test_comparison_of_two_models(spark):
    train, test = learn._train_test(spark, SF)
    specs = [registry.gaussian_spec(), registry.nearest_spec()]
    rows = comparison.compare_models(train, test, learn.PROBLEM, specs).collect()
    assert [r["position"] for r in rows] == [0, 1, 2, 3]
    assert {(r["model"], r["smote"]) for r in rows} == {
        (m, s) for m in ("Naive Bayes", "KNN") for s in comparison.SCENARIOS
    }
    assert all(r["train_seconds"] >= 0 and r["roc_auc"] is not None for r in rows)


def test_a_failing_run_does_not_end_the_others(spark):
    train, test = learn._train_test(spark, SF)

    def fail(rows, problem):
        raise RuntimeError("no such model")

    specs = [registry.gaussian_spec(), registry.ModelSpec("Broken", fail)]
    spark.sparkContext.setLocalProperty("spark.job.description", "compared")
    with pytest.warns(UserWarning, match="Broken"):
        rows = comparison.compare_models(train, test, learn.PROBLEM, specs).collect()
    assert [(r["model"], r["f1"] is None) for r in rows] == [("Naive Bayes", False)] * 2 + [("Broken", True)] * 2
    good = [r for r in rows if r["f1"] is not None]
    assert all(r["train_seconds"] > 0 and r["predict_seconds"] > 0 for r in good)
    with pytest.raises(RuntimeError, match="no such model"), pytest.warns(UserWarning):
        comparison.compare_models(train, test, learn.PROBLEM, specs[1:])


def test_cut_off_trees_equal_fitted_trees(spark):
    """Depth limits read off the full tree score like trees grown with that limit."""
    train, _ = learn._train_test(spark, SF)
    prepared = search.prepare_folds(train, X, "label", "id", folds=2, smote_k=None)
    grid = {"criterion": ["gini"], "max_depth": [2, 30], "min_samples_split": [2]}
    cv = {r["candidate_id"]: r for r in search.search_tree(prepared, X, "label", grid).collect()}
    from sievework.models import trees
    from sievework.operators import evaluate

    for fold in range(2):
        part = prepared.training.where(F.col("left_out") == fold)
        model = trees.fit_tree(part, X, "label", 4, max_depth=2)
        out = model.predict(prepared.validation.where(F.col("fold") == fold))
        score = evaluate.weighted_prf(out, "label", "prediction").first()["f1"]
        assert cv[0][f"split{fold}"] == pytest.approx(score)


def test_refit_uses_balanced_rows(spark):
    """The chosen model is fitted on all training rows after resampling."""
    train, test = learn._train_test(spark, SF)
    model = search.refit_gnb(train, X, "label", "id")
    assert len(set(model.counts)) == 1 and model.counts[0] == train.where("label = 2").count()
    params = {"max_depth": 3, "min_samples_split": 20, "max_features": None}
    tree = search.refit_tree(train, X, "label", "id", 4, params)
    out = tree.predict(test)
    assert out.count() == test.count()
    scores = sum((F.col(f"score_{i}") for i in range(1, 4)), F.col("score_0"))
    assert out.where(F.abs(scores - 1) > 1e-9).count() == 0


def test_fitted_steps_stream(spark):
    """The apply half of a fitted step takes a streaming table."""
    rows = base.imb(spark, SF)
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    model, fit = gnb.fit(rows, X, "label"), scale.fit_scaler(rows, X)
    fences = outliers.fit_fences(rows, ["x1"])
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = gnb.predict(outliers.cap_to_fences(stream, fences), model)
    out = scale.apply_scaler(out, fit)
    query = out.writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    want = scale.apply_scaler(gnb.predict(outliers.cap_to_fences(rows, fences), model), fit)
    assert spark.table("streamed").exceptAll(want).count() == 0
    assert spark.table("streamed").count() == rows.count()


def test_smote_rows_get_their_own_keys(spark):
    rows = base.imb(spark, SF)
    keyed = comparison._with_keys(smote.smote(rows, X, "label", "id"), learn.PROBLEM)
    assert keyed.count() == keyed.select("id").distinct().count()


def test_scratch_is_deleted_at_the_end_of_its_scope(spark):
    import os

    from sievework.session import materialize, scratch_scope

    kept = materialize(spark.range(3), "kept")
    with scratch_scope(spark):
        gone = materialize(spark.range(5), "gone")
        files = [f.removeprefix("file://") for f in gone.inputFiles()]
        assert gone.count() == 5 and all(map(os.path.exists, files))
    assert files and not any(map(os.path.exists, files))
    assert kept.count() == 3


def test_executors_import_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from sievework import catalog
from sievework.session import build_session
spark = build_session(2, "elsewhere", **{{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.driver.memory": "2g"}})
assert catalog.QUERIES["knn_within_class"](spark, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=300)


def test_experiments_with_both_models(spark):
    train, test = learn._train_test(spark, SF)
    plain = comparison.experiment_plain(train, test, learn.PROBLEM)
    assert {(r.model, r.smote) for r in plain.table.collect()} == {("Naive Bayes", "none"), ("Decision Tree", "none")}
    small = {"criterion": ["gini"], "max_depth": [3, None], "max_features": [None], "min_samples_leaf": [1], "min_samples_split": [2]}
    tuned = comparison.experiment_tuned(train, test, learn.PROBLEM, small)
    assert {r.smote for r in tuned.table.collect()} == {"smote_k3"} and tuned.table.count() == 2
    assert tuned.chosen["Decision Tree"]["max_depth"] in (3, None)
    assert tuned.chosen["Naive Bayes"]["var_smoothing"] in search.NB_GRID["var_smoothing"]
