"""Model-comparison tables, cross-validation tables, unions and joins, chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.base import (
    FOLDS,
    candidate_params,
    duck,
    duck_report,
    fold_scores,
    hashed_labels,
    obs,
    query,
    r6,
    results,
    runs,
    table,
)
from sievework.functions import scalars as S
from sievework.operators import charts, evaluate, outliers, ranking
from sievework.plans import comparison, search

# --- cross-validation tables ----------------------------------------------------------------

_SPLITS = [f"split{f}" for f in range(FOLDS)]


def _cv(spark, sf):
    return search.cv_results(fold_scores(spark, sf), FOLDS)


@query(
    "cv_results",
    duck("cv")
    + f"""SELECT candidate_id, {', '.join(_SPLITS)}, round_even(mean, 6) AS mean, round_even(std, 6) AS std, rank FROM cv""",
)
def cv_results(spark, sf):
    return _cv(spark, sf).withColumns({c: F.bround(c, 6) for c in ("mean", "std")})


@query(
    "best_params",
    duck("cv")
    + """SELECT candidate_id, round_even(mean, 6) AS mean, depth AS max_depth, split AS min_samples_split, leaf AS min_samples_leaf
FROM cv JOIN candlist USING (candidate_id) ORDER BY rank, candidate_id LIMIT 1""",
)
def best_params(spark, sf):
    best = search.best_candidate(_cv(spark, sf)).join(candidate_params(spark), "candidate_id")
    return best.select(
        "candidate_id",
        r6("mean", "mean"),
        *[
            F.col("params")[p].cast("int").alias(p)
            for p in ("max_depth", "min_samples_split", "min_samples_leaf")
        ],
    )


@query(
    "top_candidates",
    duck("cv") + "SELECT candidate_id, round_even(mean, 6) AS mean, rank FROM cv ORDER BY rank, candidate_id LIMIT 5",
)
def top_candidates(spark, sf):
    return search.top_candidates(_cv(spark, sf), 5).select("candidate_id", r6("mean", "mean"), "rank")


@query(
    "tuning_curve",
    duck("cv")
    + """SELECT smoothing AS var_smoothing, round_even(mean, 6) AS mean, rank,
rank = 1 AND row_number() OVER (PARTITION BY rank ORDER BY smoothing) = 1 AS is_best FROM cv JOIN candlist USING (candidate_id)""",
)
def tuning_curve(spark, sf):
    curve = search.tuning_curve(_cv(spark, sf), candidate_params(spark), "var_smoothing")
    return curve.withColumn("mean", F.bround("mean", 6))


@query(
    "rank_min",
    duck("cv") + "SELECT candidate_id, rank FROM cv",
)
def rank_min(spark, sf):
    """Ranks of the candidates; equal means share the lowest rank."""
    return _cv(spark, sf).select("candidate_id", "rank")


_FOLDED = """sizes AS (SELECT CAST(h % 5 AS INTEGER) AS fold, count(*) AS n_valid FROM labelled GROUP BY 1)"""


@query(
    "param_grid",
    duck("cv", then=_FOLDED)
    + """SELECT CAST((((c.i * 6 + d.i) * 3 + f.i) * 4 + l.i) * 4 + s.i AS INTEGER) AS candidate_id, c.v AS criterion, d.v AS max_depth,
f.v AS max_features, l.v AS min_samples_leaf, s.v AS min_samples_split,
fold, CAST((SELECT sum(n_valid) FROM sizes) - n_valid AS BIGINT) AS n_train, n_valid
FROM sizes, (VALUES (0, 'gini'), (1, 'entropy')) AS c(i, v),
(VALUES (0, 3), (1, 5), (2, 7), (3, 10), (4, 15), (5, NULL)) AS d(i, v), (VALUES (0, NULL), (1, 'sqrt'), (2, 'log2')) AS f(i, v),
(VALUES (0, 1), (1, 2), (2, 5), (3, 10)) AS l(i, v), (VALUES (0, 2), (1, 5), (2, 10), (3, 20)) AS s(i, v)""",
)
def param_grid(spark, sf):
    """Every fit of a search: grid candidates x folds with the rows each one reads."""
    folded = hashed_labels(spark, sf).select((F.col("h") % FOLDS).cast("int").alias("fold"))
    return search.fit_plan(folded, search.DT_GRID, FOLDS)


@query(
    "grid_size",
    duck("cv", then=_FOLDED)
    + """SELECT 576 AS n_candidates, CAST(count(*) AS BIGINT) AS n_folds, 576 * count(*) AS n_fits,
CAST(576 * 4 * sum(n_valid) AS BIGINT) AS rows_fitted FROM sizes""",
)
def grid_size(spark, sf):
    """Candidates of the published tree grid and the work of searching it on this table."""
    n = search.grid_size(search.DT_GRID)
    folded = hashed_labels(spark, sf).groupBy((F.col("h") % FOLDS).alias("fold")).agg(
        F.count(F.lit(1)).alias("n_valid")
    )
    folds = F.count(F.lit(1))
    return folded.agg(
        F.lit(n).alias("n_candidates"),
        folds.alias("n_folds"),
        (folds * n).alias("n_fits"),
        (F.sum("n_valid") * n * (FOLDS - 1)).alias("rows_fitted"),
    )


# --- model comparison -----------------------------------------------------------------------


@query(
    "rank_models",
    duck("results") + "SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model, smote) - 1 AS INTEGER) AS position FROM results",
)
def rank_models(spark, sf):
    return ranking.rank_models(results(spark, sf))


@query(
    "rank_within_scenario",
    duck("results") + "SELECT *, CAST(row_number() OVER (PARTITION BY smote ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM results",
)
def rank_within_scenario(spark, sf):
    return ranking.rank_within_scenario(results(spark, sf))


_EFFECT = """effect AS (SELECT a.model, a.f1 AS f1_none, b.f1 AS f1_smote, round_even(b.f1 - a.f1, 4) AS delta
FROM results a JOIN results b ON a.model = b.model AND a.smote = 'none' AND b.smote = 'smote_k3')"""


def _effect(spark, sf):
    return ranking.resampling_effect(results(spark, sf))


@query(
    "smote_effect",
    duck("results", then=_EFFECT) + "SELECT *, CASE WHEN delta > 0 THEN '+' ELSE '-' END AS mark FROM effect",
)
def smote_effect(spark, sf):
    return _effect(spark, sf)


@query(
    "effect_counts",
    duck("results", then=_EFFECT)
    + "SELECT CAST(count_if(delta > 0) AS BIGINT) AS n_improved, CAST(count(*) - count_if(delta > 0) AS BIGINT) AS n_worsened FROM effect",
)
def effect_counts(spark, sf):
    return ranking.effect_counts(_effect(spark, sf))


@query(
    "top_gains",
    duck("results", then=_EFFECT) + "SELECT model, delta FROM effect WHERE delta > 0 ORDER BY delta DESC, model LIMIT 3",
)
def top_gains(spark, sf):
    return ranking.top_gains(_effect(spark, sf))


@query("top_k_models", duck("results") + "SELECT * FROM results ORDER BY f1 DESC, model, smote LIMIT 4")
def top_k_models(spark, sf):
    return ranking.top_models(results(spark, sf))


REMARKS = [
    ("Naive Bayes", "none", "Tidak", f"Baseline - {comparison.MISSED_REMARK}"),
    ("Decision Tree", "smote_k3", "Ya", f"Model Terbaik - {comparison.FOUND_REMARK}"),
]


@query(
    "final_comparison",
    duck("results")
    + "\nUNION ALL ".join(
        f"SELECT model, smote, '{t}' AS tuning, accuracy, precision_w, recall_w, f1, '{r}' AS remark FROM results WHERE model = '{m}' AND smote = '{s}'"
        for m, s, t, r in REMARKS
    ),
)
def final_comparison(spark, sf):
    return ranking.final_comparison(results(spark, sf), REMARKS)


@query(
    "per_class_detail",
    duck("runs", then=duck_report("runs", "y", "p", "model, smote"))
    + """SELECT model, smote, CASE class WHEN 0 THEN 'Normal' WHEN 1 THEN 'Stunted' ELSE 'Severely Stunted' END AS class_name,
round_even("precision", 4) AS "precision", round_even(recall, 4) AS recall, round_even(f1, 4) AS f1, support FROM report""",
)
def per_class_detail(spark, sf):
    report = evaluate.classification_report(runs(spark, sf), "y", "p", ["model", "smote"])
    name = S.decode_label("class", S.STATUS_CODES).alias("class_name")
    detail = report.select("model", "smote", name, "precision", "recall", "f1", "support")
    return evaluate.round_metrics(detail)


@query(
    "best_per_scenario",
    duck("results")
    + """SELECT smote AS scope, model, smote, f1 FROM (SELECT *, row_number() OVER (PARTITION BY smote ORDER BY f1 DESC, model) AS rn FROM results) WHERE rn = 1
UNION ALL SELECT * FROM (SELECT 'overall', model, smote, f1 FROM results ORDER BY f1 DESC, model, smote LIMIT 1)""",
)
def best_per_scenario(spark, sf):
    return ranking.best_per_scenario(results(spark, sf))


# --- unions and joins -----------------------------------------------------------------------


@query(
    "union_all",
    "SELECT l_orderkey AS order_key, l_extendedprice AS price, l_shipdate AS shipped FROM lineitem "
    "UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders",
)
def union_all(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped")
    )
    b = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )
    return ranking.union_all(a, b)


@query(
    "self_join_scenarios",
    duck("results", then=_EFFECT) + "SELECT model, f1_none, f1_smote FROM effect",
)
def self_join_scenarios(spark, sf):
    return ranking.scenario_pairs(results(spark, sf))


@query(
    "scenario_anti",
    duck("results")
    + "SELECT DISTINCT model FROM results WHERE smote = 'none' AND model NOT IN (SELECT model FROM results WHERE smote = 'smote_k3')",
)
def scenario_anti(spark, sf):
    return ranking.scenario_only(results(spark, sf), "none", "smote_k3")


@query(
    "lookup_join",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def lookup_join(spark, sf):
    """Names from dictionary tables; Spark broadcasts them when their size allows."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return named.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "c_custkey", "n_name", "r_name"
    )


# --- chart data -----------------------------------------------------------------------------


@query(
    "chart_class_bars",
    duck("obs")
    + """SELECT sex, status AS value, count(*) AS n, round_even(count(*)::DOUBLE / any_value(t), 6) AS share
FROM obs JOIN (SELECT sex, count(status) AS t FROM obs GROUP BY sex) USING (sex) GROUP BY sex, status""",
)
def chart_class_bars(spark, sf):
    rows = obs(spark, sf).where(F.col("sex").isNotNull())
    found = charts.class_bars(rows, "status", ["sex"])
    return found.withColumn("share", F.bround("share", 6))


_BOX = """q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM obs),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)"""


@query(
    "chart_boxplot",
    duck("obs", then=_BOX)
    + """SELECT 'before' AS stage, 'price' AS column_name, round_even(any_value(q1), 6) AS q1, round_even(any_value(q2), 6) AS median,
round_even(any_value(q3), 6) AS q3, min(price) FILTER (price >= lower AND price <= upper) AS whisker_low,
max(price) FILTER (price >= lower AND price <= upper) AS whisker_high, CAST(count_if(price < lower OR price > upper) AS BIGINT) AS n_outliers FROM obs, f
UNION ALL SELECT 'after', 'price', round_even(any_value(q1), 6), round_even(any_value(q2), 6), round_even(any_value(q3), 6),
min(least(greatest(price, lower), upper)), max(least(greatest(price, lower), upper)), 0::BIGINT FROM obs, f WHERE price IS NOT NULL""",
)
def chart_boxplot(spark, sf):
    """Before and after capping. Capping moves no quartile, so the fences serve both."""
    rows = obs(spark, sf).select("price")
    fences = outliers.fit_fences(rows, ["price"])
    before = charts.boxplot_stats(rows, fences).withColumn("stage", F.lit("before"))
    capped = outliers.cap_to_fences(rows, fences)
    after = charts.boxplot_stats(capped, fences).withColumn("stage", F.lit("after"))
    both = ranking.union_all(before, after)
    return both.withColumns({c: F.bround(c, 6) for c in ("q1", "median", "q3")})


@query(
    "chart_outlier_points",
    duck("obs", then=_BOX) + "SELECT row_key, price FROM obs, f WHERE price < lower OR price > upper",
)
def chart_outlier_points(spark, sf):
    rows = obs(spark, sf).select("row_key", "price")
    return charts.outlier_points(rows, "price", outliers.fit_fences(rows, ["price"])["price"], ["row_key"])


@query(
    "chart_missing_map",
    "WITH o AS (SELECT CAST(l_orderkey // 1000 AS BIGINT) AS row_block, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS price,"
    " CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_linestatus END AS sex FROM lineitem)\n"
    "SELECT row_block, 'price' AS column_name, round_even(avg(CASE WHEN price IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_missing FROM o GROUP BY row_block\n"
    "UNION ALL SELECT row_block, 'sex', round_even(avg(CASE WHEN sex IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM o GROUP BY row_block",
)
def chart_missing_map(spark, sf):
    block = F.floor(F.split("row_key", "-")[0].cast("long") / 1000).cast("long")
    found = charts.missing_map(obs(spark, sf), block, ["price", "sex"])
    return found.withColumn("share_missing", F.bround("share_missing", 6))


@query(
    "chart_scatter_bins",
    "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x_bin, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y_bin, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL",
)
def chart_scatter_bins(spark, sf):
    rows = table(spark, sf, "lineitem")
    return charts.scatter_bins(rows, "l_quantity", "l_extendedprice", "l_returnflag", 5.0, 10000.0)


_METRICS = ["accuracy", "precision_w", "recall_w", "f1"]


@query(
    "metrics_long",
    duck("results")
    + " UNION ALL ".join(f"SELECT model, smote, '{m}' AS metric, {m} AS value FROM results" for m in _METRICS),
)
def metrics_long(spark, sf):
    return charts.metrics_long(results(spark, sf))


@query("metrics_wide", duck("results") + "SELECT model, smote, accuracy, precision_w, recall_w, f1 FROM results")
def metrics_wide(spark, sf):
    return charts.metrics_wide(charts.metrics_long(results(spark, sf)))


@query(
    "chart_top_params",
    duck("cv")
    + """SELECT candidate_id, 'depth=' || coalesce(depth::VARCHAR, 'None') || ', split=' || split || ', leaf=' || leaf AS label,
round_even(mean, 6) AS mean, round_even(std, 6) AS std, rank = 1 AS is_best FROM cv JOIN candlist USING (candidate_id) ORDER BY rank, candidate_id LIMIT 6""",
)
def chart_top_params(spark, sf):
    cv = _cv(spark, sf).join(candidate_params(spark), "candidate_id")
    p = F.col("params")
    label = S.param_label(p["max_depth"], p["min_samples_split"], p["min_samples_leaf"])
    bars = charts.top_candidate_bars(cv, label, 6)
    return bars.withColumns({c: F.bround(c, 6) for c in ("mean", "std")})


@query(
    "chart_effect_regions",
    duck("results", then=_EFFECT)
    + """SELECT model, f1_none, f1_smote, CASE WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'worsened' ELSE 'unchanged' END AS region FROM effect""",
)
def chart_effect_regions(spark, sf):
    return charts.effect_regions(_effect(spark, sf))


@query(
    "report_rows",
    duck("results")
    + """SELECT model, smote, printf('%.4f', accuracy) AS accuracy, printf('%.4f', precision_w) AS precision_w,
printf('%.4f', recall_w) AS recall_w, printf('%.4f', f1) AS f1, coalesce(printf('%.4f', roc_auc), '-') AS roc_auc FROM results""",
)
def report_rows(spark, sf):
    return ranking.report_rows(results(spark, sf))
