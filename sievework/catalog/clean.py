"""Sources, sinks, profiling, duplicates, imputing, outliers and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.catalog.base import (
    FEATURES,
    duck,
    duck_strip,
    duck_title,
    evt,
    imb,
    obs,
    obs_dup,
    query,
    r6,
    results,
    table,
)
from sievework.functions import scalars as S
from sievework.operators import dedup, impute as imp, outliers, profile, scale, sketches
from sievework.plans import cleaning
from sievework.session import materialize, scratch_path
from sievework.sources import scan, sink

# --- sources and sinks ----------------------------------------------------------------------


@query(
    "scan_delimited",
    duck("obs") + "SELECT row_key, TRY_CAST(qty_raw AS DOUBLE) AS qty_raw, price, sex, status FROM obs",
)
def scan_delimited(spark, sf):
    """Semicolon text with untidy cells, read back under a declared schema."""
    path = scratch_path(spark, "delimited")
    sink.write_delimited(obs(spark, sf), path, sep=";")
    schema = T.StructType(
        [
            T.StructField("row_key", T.StringType()),
            T.StructField("qty_raw", T.DoubleType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("sex", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    )
    return scan.scan_delimited(spark, path, schema)


@query("scan_quoted_breaks", "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars, lang FROM documents")
def scan_quoted_breaks(spark, sf):
    """Texts with line breaks inside quotes, every byte range of a file read on its own."""
    path = scratch_path(spark, "quoted")
    sink.write_delimited(table(spark, sf, "documents").select("doc_id", "text", "lang"), path, sep=";", escape_breaks=False)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    rows = scan.scan_delimited(spark, path, schema, missing=[""], multi_line=True)
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "lang")


@query("scan_stage", duck("imb") + "SELECT label, count(*) AS n, sum(x1) AS x1 FROM imb GROUP BY label")
def scan_stage(spark, sf):
    rows = imb(spark, sf)
    path = scratch_path(spark, "stage")
    rows.write.parquet(path)
    back = scan.scan_stage(spark, path, rows.schema)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("x1"))


@query(
    "scan_optional",
    "SELECT n_nationkey, n_name FROM nation",
)
def scan_optional(spark, sf):
    """An existing table, and one that does not exist and so adds no rows."""
    schema = T.StructType(
        [T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]
    )
    found = scan.scan_optional_or_empty(spark, f"{sf}/nation.parquet", schema)
    absent = scan.scan_optional_or_empty(spark, f"{sf}/nation_absent.parquet", schema)
    return found.unionByName(absent)


@query("sink_csv_roundtrip", duck("obs") + "SELECT * FROM obs")
def sink_csv_roundtrip(spark, sf):
    rows = obs(spark, sf)
    path = scratch_path(spark, "csv")
    sink.write_delimited(rows, path)
    return scan.scan_delimited(spark, path, rows.schema, sep=",", missing=[""])


@query(
    "stage_snapshot",
    duck("obs") + "SELECT sex, count(*) AS n, round_even(sum(price), 2) AS price FROM obs GROUP BY sex",
)
def stage_snapshot(spark, sf):
    stage = sink.write_stage(obs(spark, sf), scratch_path(spark, "stages"), "00_raw")
    total = F.bround(F.sum("price"), 2).alias("price")
    return stage.groupBy("sex").agg(F.count(F.lit(1)).alias("n"), total)


@query(
    "sink_by_slug",
    duck("results")
    + """SELECT smote, f1, replace(regexp_replace(lower(model || ' (' || smote || ')'), '[()]', '', 'g'), ' ', '_') AS model_slug
FROM results""",
)
def sink_by_slug(spark, sf):
    path = scratch_path(spark, "by-slug")
    named = results(spark, sf).withColumn(
        "name", F.concat("model", F.lit(" ("), "smote", F.lit(")"))
    )
    sink.write_by_slug(named, path, "name")
    return scan.scan_stage(spark, path).select("smote", "f1", "model_slug")


_CLEAN = (
    f"""named AS (SELECT row_key, TRY_CAST(qty_raw AS DOUBLE) AS qty_raw, price,
CASE {duck_strip('sex')} WHEN 'L' THEN 'Laki-Laki' WHEN 'P' THEN 'Perempuan' END AS sex,
{duck_title('status')} AS status FROM obs),
"""
    # Duplicates are judged before the number is read, so the raw text takes part.
    + f"""raw_named AS (SELECT o.row_key, o.qty_raw AS q, n.price, n.sex, n.status, n.qty_raw FROM obs o JOIN named n USING (row_key)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, price, sex, status ORDER BY row_key) AS rn FROM raw_named) WHERE rn = 1),
fills AS (SELECT quantile_cont(qty_raw, 0.5) AS mq, quantile_cont(price, 0.5) AS mp,
 (SELECT sex FROM firsts WHERE sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1) AS ms FROM firsts),
filled AS (SELECT row_key, coalesce(qty_raw, mq) AS qty_raw, coalesce(price, mp) AS price, coalesce(sex, ms) AS sex, status,
 CASE WHEN qty_raw IS NULL THEN 1 ELSE 0 END AS qty_raw_was_missing,
 CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_was_missing FROM firsts, fills),
fence AS (SELECT quantile_cont(qty_raw, 0.25) AS q1, quantile_cont(qty_raw, 0.75) AS q3,
 quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3,
 avg(qty_raw) AS qm, stddev_pop(qty_raw) AS qs, avg(price) AS pm, stddev_pop(price) AS ps FROM filled)"""
)


def _run_cleaning(spark, sf):
    return cleaning.clean(
        obs(spark, sf),
        title=["status"],
        recodes={"sex": S.SEX_NAMES},
        numeric=["qty_raw", "price"],
        dataset="obs",
        key="row_key",
    )


@query(
    "cleaning_summary",
    duck("obs", then=_CLEAN)
    + """, c AS (SELECT count_if(qty_raw < q1 - 1.5 * (q3 - q1) OR qty_raw > q3 + 1.5 * (q3 - q1)) AS qi,
 count_if(price < p1 - 1.5 * (p3 - p1) OR price > p3 + 1.5 * (p3 - p1)) AS pi,
 count_if(abs((qty_raw - qm) / qs) > 3) AS qz, count_if(abs((price - pm) / ps) > 3) AS pz,
 count(*) AS n, any_value((SELECT count(*) FROM obs)) AS b FROM filled, fence),
m AS (SELECT count_if(qty_raw IS NULL) + count_if(price IS NULL) + count_if(sex IS NULL) AS mb FROM firsts)
SELECT t.line_no, t.line FROM c, m, LATERAL (VALUES
 (1, 'Dataset: obs'), (2, 'Total Sampel Awal: ' || b), (3, 'Total Sampel Akhir: ' || n), (4, 'Jumlah Kolom: 7'),
 (5, ''), (6, 'TAHAPAN YANG TELAH DILAKUKAN:'), (7, '1. Data Preprocessing:'),
 (8, '   - Fix inkonsistensi nilai status (spasi, kapitalisasi)'), (9, '   - Standardisasi kolom sex (L/P -> Laki-Laki/Perempuan)'),
 (10, '   - Konversi tipe data numerik: qty_raw, price'),
 (11, '   - Deteksi dan hapus duplikasi data (' || (b - n) || ' duplikat dihapus)'),
 (12, ''), (13, '2. Handling Missing Values:'),
 (14, '   - ' || CASE WHEN mb = 0 THEN 'Tidak ditemukan missing values dalam dataset' ELSE 'Missing values telah ditangani' END),
 (15, ''), (16, '3. Outlier Detection & Handling:'),
 (17, '   - Metode IQR: qty_raw: ' || qi || ' outlier, price: ' || pi || ' outlier'),
 (18, '   - Metode Z-Score: qty_raw: ' || qz || ' outlier, price: ' || pz || ' outlier'),
 (19, '   - Penanganan: Capping/Winsorization (mengganti outlier dengan batas IQR)')) AS t(line_no, line)""",
)
def cleaning_summary(spark, sf):
    """The whole cleaning run, reported as its text summary."""
    return sink.summary_lines(_run_cleaning(spark, sf).summary)


@query(
    "cleaned_table",
    duck("obs", then=_CLEAN)
    + """SELECT row_key, round_even(least(greatest(qty_raw, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS qty_raw,
round_even(least(greatest(price, p1 - 1.5 * (p3 - p1)), p3 + 1.5 * (p3 - p1)), 6) AS price, sex, status,
qty_raw_was_missing, price_was_missing FROM filled, fence""",
)
def cleaned_table(spark, sf):
    """The whole cleaning run, its rows."""
    rows = _run_cleaning(spark, sf).clean
    return rows.withColumns({c: F.bround(c, 6) for c in ("qty_raw", "price")})


# --- profiling ------------------------------------------------------------------------------


@query("value_counts", duck("obs") + "SELECT status, count(*) AS n FROM obs GROUP BY status")
def value_counts(spark, sf):
    return profile.value_counts(obs(spark, sf), "status")


@query(
    "value_counts_pct",
    duck("obs")
    + "SELECT sex, round_even(count(*) * 100.0::DOUBLE / (SELECT count(sex) FROM obs), 2) AS pct FROM obs WHERE sex IS NOT NULL GROUP BY sex",
)
def value_counts_pct(spark, sf):
    return profile.value_shares(obs(spark, sf), "sex")


@query(
    "distribution_table",
    duck("obs", then=f"unique_rows AS (SELECT DISTINCT {duck_title('status')} AS status, qty_raw, price, sex FROM obs)")
    + """SELECT status, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM unique_rows), 2) AS pct
FROM unique_rows GROUP BY status""",
)
def distribution_table(spark, sf):
    """Class distribution of the standardised, de-duplicated observations."""
    rows = cleaning.standardize(obs(spark, sf).drop("row_key"), ["status"], {})
    return profile.distribution_table(dedup.drop_duplicates(rows), "status")


@query("class_counts", duck("evt") + "SELECT label_name, count(*) AS n FROM evt GROUP BY label_name")
def class_counts(spark, sf):
    return profile.class_counts(evt(spark, sf), "label_name")


@query("distinct_values", duck("obs") + "SELECT DISTINCT qty_raw FROM obs")
def distinct_values(spark, sf):
    return profile.distinct_values(obs(spark, sf), "qty_raw")


def _duck_describe(cols: list[str], source: str, digits: int) -> str:
    stats = [
        ("count", "count({c})::DOUBLE"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
        ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
        ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})"),
    ]
    parts = [
        f"SELECT '{s}' AS statistic, " + ", ".join(f"round_even({e.format(c=c)}, {digits}) AS {c}" for c in cols) + f" FROM {source}"
        for s, e in stats
    ]
    return "\nUNION ALL ".join(parts)


@query(
    "describe_numeric",
    _duck_describe(["l_quantity", "l_extendedprice", "l_discount"], "lineitem", 2),
)
def describe_numeric(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return profile.describe_numeric(rows)


def _duck_describe_all() -> str:
    def fmt(e: str) -> str:
        return f"printf('%.2f', round_even({e}, 2))"

    def top(c: str, what: str) -> str:
        return f"(SELECT {what} FROM (SELECT {c} AS v, count(*) AS n FROM obs WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v LIMIT 1)"

    text = ["qty_raw", "sex", "status"]
    rows = []
    for s, t, p in [
        ("count", "count({c})::VARCHAR", "count(price)::DOUBLE"),
        ("unique", "count(DISTINCT {c})::VARCHAR", None),
        ("top", "top", None),
        ("freq", "freq", None),
        ("mean", None, "avg(price)"),
        ("std", None, "stddev_samp(price)"),
        ("min", None, "min(price)"),
        ("25%", None, "quantile_cont(price, 0.25)"),
        ("50%", None, "quantile_cont(price, 0.5)"),
        ("75%", None, "quantile_cont(price, 0.75)"),
        ("max", None, "max(price)"),
    ]:
        cells = []
        for c in text:
            if t is None:
                e = "NULL::VARCHAR"
            elif t == "top":
                e = top(c, "v")
            elif t == "freq":
                e = top(c, "n::VARCHAR")
            else:
                e = t.format(c=c)
            cells.append(f"{e} AS {c}")
        cells.append((fmt(p) if p else "NULL::VARCHAR") + " AS price")
        rows.append(f"SELECT '{s}' AS statistic, {', '.join(cells)} FROM obs")
    return "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join(rows) + ")"


@query("describe_all", duck("obs") + _duck_describe_all())
def describe_all(spark, sf):
    return profile.describe_all(obs(spark, sf).drop("row_key"))


@query("count_if", duck("obs") + "SELECT CAST(count_if(price > 50000) AS BIGINT) AS n FROM obs")
def count_if(spark, sf):
    return profile.count_where(obs(spark, sf), F.col("price") > 50000)


@query(
    "missing_profile",
    duck("obs")
    + """SELECT column_name, n AS n_missing, round_even(n * 100.0::DOUBLE / t, 2) AS pct_missing FROM (
SELECT 'price' AS column_name, count(*) - count(price) AS n, count(*) AS t FROM obs
UNION ALL SELECT 'sex', count(*) - count(sex), count(*) FROM obs) WHERE n > 0""",
)
def missing_profile(spark, sf):
    return profile.missing_profile(obs(spark, sf))


@query(
    "missing_total",
    duck("obs")
    + "SELECT CAST(count_if(price IS NULL) + count_if(sex IS NULL) + count_if(qty_raw IS NULL) AS BIGINT) AS n_missing FROM obs",
)
def missing_total(spark, sf):
    return profile.missing_total(obs(spark, sf))


@query(
    "median_exact",
    duck("obs")
    + """SELECT 'price' AS column_name, round_even(quantile_cont(price, 0.5), 6) AS median FROM obs
UNION ALL SELECT 'qty', round_even(quantile_cont(TRY_CAST(qty_raw AS DOUBLE), 0.5), 6) FROM obs""",
)
def median_exact(spark, sf):
    rows = obs(spark, sf).select("price", S.to_numeric("qty_raw").alias("qty"))
    return profile.median(rows, ["price", "qty"]).select("column_name", r6("median", "median"))


@query(
    "mode_smallest",
    duck("obs") + "SELECT qty_raw AS mode, count(*) AS n FROM obs GROUP BY qty_raw ORDER BY n DESC, mode LIMIT 1",
)
def mode_smallest(spark, sf):
    return profile.mode_smallest(obs(spark, sf), "qty_raw")


@query(
    "quantiles",
    """SELECT c AS column_name, p AS prob, round_even(v, 6) AS value FROM (
SELECT 'l_extendedprice' AS c, unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p,
 unnest(quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99])) AS v FROM lineitem
UNION ALL SELECT 'l_tax', unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE,
 unnest(quantile_cont(l_tax, [0.01, 0.25, 0.5, 0.75, 0.99])) FROM lineitem)""",
)
def quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", "l_tax")
    found = profile.quantiles(rows, ["l_extendedprice", "l_tax"], [0.01, 0.25, 0.5, 0.75, 0.99])
    return found.select("column_name", "prob", r6("value", "value"))


@query(
    "quantiles_large",
    """SELECT 'value' AS column_name, unnest([0.05, 0.5, 0.95])::DOUBLE AS prob,
 round_even(unnest(quantile_cont(value, [0.05, 0.5, 0.95])), 6) AS value FROM events""",
)
def quantiles_large(spark, sf):
    """The same quantiles by the histogram search used beyond the one-buffer size."""
    from sievework.operators import order_stats

    rows = table(spark, sf, "events").select("value")
    probs = [0.05, 0.5, 0.95]
    found = order_stats.quantile_table(rows, ["value"], probs, direct_rows=0)["value"]
    cells = [("value", p, v) for p, v in zip(probs, found)]
    out = spark.createDataFrame(cells, "column_name string, prob double, value double")
    return out.select("column_name", "prob", r6("value", "value"))


@query(
    "quantile_sketches",
    """SELECT event_type, prob, count(value) AS n, TRUE AS within FROM events, (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])::DOUBLE AS prob)
GROUP BY event_type, prob""",
)
def quantile_sketches(spark, sf):
    """Quantiles per event type from sketches of two batches, merged; their true ranks are counted.

    ``within`` says that the rank is no farther from the wanted one than the sketch's bound."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    parts = [
        sketches.sketch_table(rows.where(F.col("event_id") % 3 == 0), ["value"], ["event_type"]),
        sketches.sketch_table(rows.where(F.col("event_id") % 3 != 0), ["value"], ["event_type"]),
    ]
    merged = materialize(sketches.merge(parts, ["event_type"]), "sketches")
    found = sketches.quantiles(merged, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
    return sketches.rank_errors(rows, found, "value", ["event_type"]).select(
        "event_type", "prob", "n", (F.col("error") <= sketches.rank_bound()).alias("within")
    )


@query(
    "moments",
    duck("obs")
    + """SELECT 'price' AS column_name, count(price) AS n, round_even(avg(price), 6) AS mean, round_even(stddev_pop(price), 6) AS std_pop,
round_even(stddev_samp(price), 6) AS std_samp, min(price) AS min, max(price) AS max FROM obs""",
)
def moments(spark, sf):
    found = profile.moments(obs(spark, sf), ["price"])
    return found.withColumns({c: F.bround(c, 6) for c in ("mean", "std_pop", "std_samp")})


@query(
    "pearson_corr",
    "SELECT round_even(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem",
)
def pearson_corr(spark, sf):
    found = profile.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select(r6("pearson_r", "pearson_r"))


@query(
    "before_after",
    duck("obs")
    + """SELECT t.aspect, t.before, t.after FROM (SELECT count(*) AS n, count_if(price IS NULL) + count_if(sex IS NULL) AS m FROM obs) b,
(SELECT count(*) AS n FROM (SELECT DISTINCT qty_raw, price, sex, status FROM obs)) a,
LATERAL (VALUES ('rows', b.n, a.n), ('columns', 4::BIGINT, 6::BIGINT - 1), ('missing', b.m::BIGINT, 0::BIGINT),
('duplicates_removed', NULL::BIGINT, b.n - a.n)) AS t(aspect, before, after)""",
)
def before_after(spark, sf):
    before = obs(spark, sf).drop("row_key")
    # Fitted on, filled and counted from one written table.
    unique = materialize(dedup.drop_duplicates(before), "unique")
    removed = before.count() - unique.count()
    return profile.before_after(before, imp.impute(unique), removed)


@query(
    "best_by_metric",
    duck("results") + "SELECT * FROM results ORDER BY f1 DESC, model LIMIT 1",
)
def best_by_metric(spark, sf):
    return profile.best_by_metric(results(spark, sf), "f1", "model")


@query(
    "argmin_by",
    duck("evt")
    + """SELECT label_name, id, value FROM (SELECT *, row_number() OVER (PARTITION BY label_name ORDER BY value, id) AS rn FROM evt) WHERE rn = 1""",
)
def argmin_by(spark, sf):
    return profile.argmin_by(evt(spark, sf), "id", "value", ["label_name"])


# --- duplicates -----------------------------------------------------------------------------


@query(
    "duplicate_count",
    duck("obs_dup")
    + "SELECT (SELECT count(*) FROM obs_dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM obs_dup)) AS n_duplicates",
)
def duplicate_count(spark, sf):
    return dedup.duplicate_count(obs_dup(spark, sf))


@query("drop_duplicates", duck("obs_dup") + "SELECT DISTINCT * FROM obs_dup")
def drop_duplicates(spark, sf):
    return dedup.drop_duplicates(obs_dup(spark, sf))


@query(
    "drop_duplicates_first",
    duck("obs")
    + """SELECT row_key, qty_raw, price, sex, status FROM (SELECT *, row_number() OVER
(PARTITION BY qty_raw, sex, status ORDER BY row_key) AS rn FROM obs) WHERE rn = 1""",
)
def drop_duplicates_first(spark, sf):
    return dedup.drop_duplicates_first(obs(spark, sf), ["qty_raw", "sex", "status"], ["row_key"])


# --- imputing -------------------------------------------------------------------------------


@query(
    "impute_median",
    duck("obs")
    + """SELECT row_key, round_even(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM obs)), 6) AS price,
CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_was_missing FROM obs""",
)
def impute_median(spark, sf):
    filled = imp.impute(obs(spark, sf).select("row_key", "price"), ["price"])
    return filled.withColumn("price", F.bround("price", 6))


_MODE = "(SELECT {c} FROM obs WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mode",
    duck("obs") + f"SELECT row_key, coalesce(sex, {_MODE.format(c='sex')}) AS sex FROM obs",
)
def impute_mode(spark, sf):
    return imp.impute(obs(spark, sf).select("row_key", "sex"), ["sex"])


_IMPUTED = f"""num AS (SELECT row_key, TRY_CAST(qty_raw AS DOUBLE) AS qty, price, sex, status FROM obs),
filled AS (SELECT row_key, round_even(coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM num)), 6) AS qty,
round_even(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM num)), 6) AS price,
coalesce(sex, {_MODE.format(c='sex')}) AS sex, status, CASE WHEN qty IS NULL THEN 1 ELSE 0 END AS qty_was_missing,
CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_was_missing FROM num)"""


def _typed(spark, sf):
    return obs(spark, sf).select(
        "row_key", S.to_numeric("qty_raw").alias("qty"), "price", "sex", "status"
    )


@query("impute_auto", duck("obs", then=_IMPUTED) + "SELECT * FROM filled")
def impute_auto(spark, sf):
    filled = imp.impute(_typed(spark, sf))
    return filled.withColumns({c: F.bround(c, 6) for c in ("qty", "price")})


@query(
    "impute_auto_plain",
    duck("obs", then=_IMPUTED) + "SELECT row_key, qty, price, sex, status FROM filled",
)
def impute_auto_plain(spark, sf):
    filled = imp.impute(_typed(spark, sf), add_indicator=False)
    return filled.withColumns({c: F.bround(c, 6) for c in ("qty", "price")})


# --- outliers and scaling -------------------------------------------------------------------

_FENCES = """q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM obs),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)"""


@query(
    "iqr_fences",
    duck("obs", then=_FENCES)
    + """SELECT 'price' AS column_name, round_even(any_value(q1), 6) AS q1, round_even(any_value(q3), 6) AS q3,
round_even(any_value(iqr), 6) AS iqr, round_even(any_value(lower), 6) AS lower, round_even(any_value(upper), 6) AS upper,
CAST(count_if(price < lower OR price > upper) AS BIGINT) AS n_iqr,
round_even(count_if(price < lower OR price > upper) * 100.0::DOUBLE / count(*), 6) AS pct_iqr FROM obs, f""",
)
def iqr_fences(spark, sf):
    rows = obs(spark, sf)
    found = outliers.fence_table(rows, outliers.fit_fences(rows, ["price"]))
    return found.withColumns({c: F.bround(c, 6) for c in ("q1", "q3", "iqr", "lower", "upper", "pct_iqr")})


@query(
    "zscore_outliers",
    duck("obs")
    + """SELECT 'price' AS column_name, round_even(any_value(m), 6) AS mean, round_even(any_value(s), 6) AS std_pop,
CAST(count_if(abs((price - m) / s) > 3) AS BIGINT) AS n_zscore,
round_even(count_if(abs((price - m) / s) > 3) * 100.0::DOUBLE / count(*), 6) AS pct_zscore
FROM obs, (SELECT avg(price) AS m, stddev_pop(price) AS s FROM obs)""",
)
def zscore_outliers(spark, sf):
    found = outliers.zscore_table(obs(spark, sf), ["price"])
    return found.withColumns({c: F.bround(c, 6) for c in ("mean", "std_pop", "pct_zscore")})


@query(
    "winsorize_iqr",
    duck("obs", then=_FENCES)
    + "SELECT row_key, CASE WHEN price IS NOT NULL THEN round_even(least(greatest(price, lower), upper), 6) END AS price FROM obs, f",
)
def winsorize_iqr(spark, sf):
    rows = obs(spark, sf).select("row_key", "price")
    capped = outliers.cap_to_fences(rows, outliers.fit_fences(rows, ["price"]))
    return capped.withColumn("price", F.bround("price", 6))


@query(
    "capping_report",
    duck("obs", then=_FENCES)
    + """SELECT 'price' AS column_name, CAST(count_if(price < lower OR price > upper) AS BIGINT) AS n_before, 0::BIGINT AS n_after,
CAST(count_if(price < lower OR price > upper) AS BIGINT) AS n_capped FROM obs, f""",
)
def capping_report(spark, sf):
    rows = obs(spark, sf)
    return outliers.capping_report(rows, outliers.fit_fences(rows, ["price"]))


@query(
    "standard_scale",
    duck("imb")
    + """SELECT id, label, round_even((x1 - m1) / s1, 6) AS x1, round_even((x2 - m2) / s2, 6) AS x2,
round_even((x3 - m3) / s3, 6) AS x3 FROM imb, (SELECT avg(x1) AS m1, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1,
avg(x2) AS m2, coalesce(nullif(stddev_pop(x2), 0), 1) AS s2, avg(x3) AS m3, coalesce(nullif(stddev_pop(x3), 0), 1) AS s3 FROM imb)""",
)
def standard_scale(spark, sf):
    rows = imb(spark, sf)
    scaled = scale.apply_scaler(rows, scale.fit_scaler(rows, FEATURES))
    return scaled.withColumns({c: F.bround(c, 6) for c in FEATURES})
