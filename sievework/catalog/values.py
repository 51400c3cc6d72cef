"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sievework.catalog.base import (
    duck,
    duck_report,
    duck_strip,
    duck_title,
    candidate_params,
    evt,
    fold_scores,
    imb,
    obs,
    pred,
    query,
    r6,
    results,
    table,
)
from sievework.functions import scalars as S
from sievework.operators import evaluate, profile, project
from sievework.plans import search


@query(
    "standardize_columns",
    duck("obs") + "SELECT row_key, qty_raw AS umur_bulan, price AS tinggi, sex AS jk, status FROM obs",
)
def standardize_columns(spark, sf):
    raw = project.rename_columns(obs(spark, sf), ["Row Key", " Umur Bulan", "Tinggi", "JK ", "Status"])
    return project.standardize_columns(raw)


@query(
    "rename_columns",
    duck("obs") + "SELECT status, count(*) AS jumlah FROM obs GROUP BY status",
)
def rename_columns(spark, sf):
    return project.rename_columns(profile.value_counts(obs(spark, sf), "status"), ["status", "jumlah"])


@query("select_columns", duck("obs") + "SELECT row_key, price, status FROM obs")
def select_columns(spark, sf):
    return project.select_columns(obs(spark, sf), ["row_key", "price", "status"])


@query("select_pattern", "SELECT l_orderkey, l_partkey, l_suppkey, l_tax FROM lineitem")
def select_pattern(spark, sf):
    return project.select_pattern(table(spark, sf, "lineitem"), ["*key", "l_tax"])


@query("drop_columns", "SELECT event_id, ts, user_id, event_type FROM events")
def drop_columns(spark, sf):
    return project.drop_columns(table(spark, sf, "events"), ["value", "props"])


@query("literal_column", duck("evt") + "SELECT *, 'none' AS smote, 0 AS tuned FROM evt")
def literal_column(spark, sf):
    return project.with_constants(evt(spark, sf), {"smote": "none", "tuned": 0})


@query(
    "filter_compare",
    duck("obs")
    + """, m AS (SELECT 'row_key' AS column_name, count(*) - count(row_key) AS n_missing FROM obs
 UNION ALL SELECT 'qty_raw', count(*) - count(qty_raw) FROM obs
 UNION ALL SELECT 'price', count(*) - count(price) FROM obs
 UNION ALL SELECT 'sex', count(*) - count(sex) FROM obs
 UNION ALL SELECT 'status', count(*) - count(status) FROM obs)
SELECT * FROM m WHERE n_missing > 0""",
)
def filter_compare(spark, sf):
    counts = profile.missing_counts(obs(spark, sf)).drop("n_rows")
    return counts.where(F.col("n_missing") > 0)


@query("filter_equal", duck("results") + "SELECT * FROM results WHERE smote = 'none'")
def filter_equal(spark, sf):
    return results(spark, sf).where(F.col("smote") == "none")


@query(
    "filter_and",
    duck("obs") + "SELECT row_key, price FROM obs WHERE status = 'Normal' AND sex = 'L'",
)
def filter_and(spark, sf):
    rows = obs(spark, sf).where((F.col("status") == "Normal") & (F.col("sex") == "L"))
    return rows.select("row_key", "price")


@query("head_n", duck("obs") + "SELECT * FROM obs ORDER BY row_key LIMIT 5")
def head_n(spark, sf):
    return project.head_n(obs(spark, sf), 5, "row_key")


@query(
    "table_profile",
    duck("imb")
    + """SELECT t.ordinal, t.column_name, t.dtype, n.n_rows
FROM (VALUES (1, 'id', 'bigint'), (2, 'label', 'int'), (3, 'x1', 'double'), (4, 'x2', 'double'),
             (5, 'x3', 'double')) AS t(ordinal, column_name, dtype),
     (SELECT count(*) AS n_rows FROM imb) AS n""",
)
def table_profile(spark, sf):
    return project.table_profile(imb(spark, sf))


@query("assemble_features", duck("imb") + "SELECT id, label, x1 AS f0, x2 AS f1, x3 AS f2 FROM imb")
def assemble_features(spark, sf):
    """The elements of the assembled vector, in order."""
    found = project.assemble_features(imb(spark, sf), ["x1", "x2", "x3"])
    vector = vector_to_array("features")
    return found.select("id", "label", *[vector[i].alias(f"f{i}") for i in range(3)])


@query("str_strip", duck("obs") + f"SELECT row_key, {duck_strip('status')} AS status, {duck_strip('sex')} AS sex FROM obs")
def str_strip(spark, sf):
    return obs(spark, sf).select(
        "row_key", S.strip("status").alias("status"), S.strip("sex").alias("sex")
    )


@query(
    "str_title",
    duck("obs")
    + f"SELECT row_key, {duck_title('status')} AS status, {duck_title('lower(qty_raw || sex)')} AS mixed FROM obs",
)
def str_title(spark, sf):
    return obs(spark, sf).select(
        "row_key",
        S.title_case(S.strip("status")).alias("status"),
        S.title_case(S.strip(F.lower(F.concat("qty_raw", "sex")))).alias("mixed"),
    )


@query(
    "str_slug",
    "SELECT p_partkey, replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[()]', '', 'g'), ' ', '_') AS slug FROM part",
)
def str_slug(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", S.slug(name).alias("slug"))


@query(
    "recode_map",
    duck("obs")
    + f"""SELECT row_key, CASE {duck_strip('sex')} WHEN 'L' THEN 'Laki-Laki' WHEN 'P' THEN 'Perempuan' END AS sex,
CASE qty_raw WHEN '1' THEN 'one' END AS few FROM obs""",
)
def recode_map(spark, sf):
    return obs(spark, sf).select(
        "row_key",
        S.recode(S.strip("sex"), S.SEX_NAMES).alias("sex"),
        S.recode("qty_raw", {"1": "one"}).alias("few"),
    )


_CODE = f"CASE {duck_title('status')} WHEN 'Normal' THEN 0 WHEN 'Stunted' THEN 1 WHEN 'Severely Stunted' THEN 2 END"


def _coded(spark, sf):
    status = S.title_case(S.strip("status"))
    return obs(spark, sf).withColumn("status_encoded", S.encode_label(status, S.STATUS_CODES))


@query("label_encode", duck("obs") + f"SELECT row_key, {_CODE} AS status_encoded FROM obs")
def label_encode(spark, sf):
    return _coded(spark, sf).select("row_key", "status_encoded")


@query(
    "label_decode",
    duck("obs")
    + f"SELECT row_key, CASE {_CODE} WHEN 0 THEN 'Normal' WHEN 1 THEN 'Stunted' WHEN 2 THEN 'Severely Stunted' END AS status FROM obs",
)
def label_decode(spark, sf):
    return _coded(spark, sf).select(
        "row_key", S.decode_label("status_encoded", S.STATUS_CODES).alias("status")
    )


@query(
    "lookup_default",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
)
def lookup_default(spark, sf):
    code = S.lookup_default("o_orderstatus", {"F": 1, "O": 2}, 0)
    return table(spark, sf, "orders").select("o_orderkey", code.alias("code"))


@query("to_numeric_coerce", duck("obs") + "SELECT row_key, TRY_CAST(qty_raw AS DOUBLE) AS qty FROM obs")
def to_numeric_coerce(spark, sf):
    return obs(spark, sf).select("row_key", S.to_numeric("qty_raw").alias("qty"))


@query(
    "clip_bounds",
    duck("obs")
    + "SELECT row_key, CASE WHEN price IS NOT NULL THEN least(greatest(price, 20000.0::DOUBLE), 60000.0::DOUBLE) END AS price FROM obs",
)
def clip_bounds(spark, sf):
    return obs(spark, sf).select("row_key", S.clip("price", 20000.0, 60000.0).alias("price"))


@query(
    "round_half_even",
    # Half-even on the shown decimal value, spelled out in exact decimals.
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 8, 1) AS v1,
(f + CASE WHEN d - f > 0.5 OR (d - f = 0.5 AND f % 2 = 1) THEN 1 ELSE 0 END)::BIGINT / 100::DOUBLE AS v2 FROM (
SELECT *, floor(d)::BIGINT AS f FROM (SELECT *, CAST(CAST(l_extendedprice * l_discount AS VARCHAR) AS DECIMAL(30, 15)) * 100 AS d FROM lineitem))""",
)
def round_half_even(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.round_half_even(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("v2"),
        S.round_half_even(F.col("l_quantity") / 8, 1).alias("v1"),
    )


@query(
    "format_numbers",
    """SELECT o_orderkey, printf('%.4f', o_totalprice) AS fixed, printf('%+.4f', o_totalprice - 150000) AS signed,
printf('%.1f%%', o_totalprice / 400000 * 100) AS percent, printf('%.1e', o_totalprice) AS scientific,
printf('%-15s', o_orderpriority) AS padded FROM orders""",
)
def format_numbers(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.fmt_fixed(price).alias("fixed"),
        S.fmt_signed(price - 150000).alias("signed"),
        S.fmt_percent(price / 400000).alias("percent"),
        S.fmt_scientific(price).alias("scientific"),
        S.fmt_left("o_orderpriority", 15).alias("padded"),
    )


@query(
    "param_label",
    duck("cv")
    + """SELECT candidate_id, 'depth=' || coalesce(depth::VARCHAR, 'None') || ', split=' || split || ', leaf=' || leaf AS label,
round_even(mean, 6) AS mean FROM cv JOIN candlist USING (candidate_id)""",
)
def param_label(spark, sf):
    p = F.col("params")
    label = S.param_label(p["max_depth"], p["min_samples_split"], p["min_samples_leaf"])
    cv = search.cv_results(fold_scores(spark, sf), 5)
    return cv.join(candidate_params(spark), "candidate_id").select(
        "candidate_id", label.alias("label"), r6("mean", "mean")
    )


@query(
    "verdict_case",
    duck("pred", then=duck_report("pred", "label", "prediction", ""))
    + """SELECT class, CASE WHEN recall = 0 THEN 'GAGAL total!' ELSE 'Terbatas' END AS verdict,
CASE WHEN recall > 0.5 THEN 'Baik' ELSE 'Perlu ditingkatkan' END AS grade FROM report""",
)
def verdict_case(spark, sf):
    report = evaluate.classification_report(pred(spark, sf), "label", "prediction")
    return report.select(
        "class", S.recall_verdict("recall").alias("verdict"), S.recall_grade("recall").alias("grade")
    )


@query(
    "localized_date",
    """SELECT o_orderkey, day(o_orderdate) || ' ' || (['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli',
'Agustus', 'September', 'Oktober', 'November', 'Desember'])[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders""",
)
def localized_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.localized_date("o_orderdate").alias("shown"))


@query(
    "logspace_grid",
    """WITH b AS (SELECT log10(min(value)) AS lo, log10(max(value)) AS hi FROM events WHERE value > 0),
g AS (SELECT i::INTEGER AS step, pow(10::DOUBLE, lo + (hi - lo) * i / 7) AS point, lo, hi FROM b, range(8) AS t(i)),
n AS (SELECT least(floor((log10(value) - lo) / (hi - lo) * 7), 6)::INTEGER AS step, count(*) AS n
      FROM events, b WHERE value > 0 GROUP BY 1)
SELECT g.step, round_even(point, 6) AS point, coalesce(n, 0) AS n_above FROM g LEFT JOIN n ON g.step = n.step""",
)
def logspace_grid(spark, sf):
    """Log-spaced points between the smallest and largest value, with the rows of each step."""
    rows = table(spark, sf, "events").select("value").where(F.col("value") > 0)
    ends = rows.agg(F.log10(F.min("value")).alias("lo"), F.log10(F.max("value")).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    place = F.floor((F.log10("value") - F.lit(lo)) / F.lit(hi - lo) * 7)
    counts = rows.groupBy(F.least(place, F.lit(6)).cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = spark.createDataFrame(list(enumerate(S.logspace(lo, hi, 8))), "step int, point double")
    return grid.join(counts, "step", "left").select(
        "step", r6("point", "point"), F.coalesce("n", F.lit(0)).alias("n_above")
    )
