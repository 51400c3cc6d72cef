"""Registry of queries and the tables derived from the given ones that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import portable
from sievework.operators import evaluate

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows where SQL can."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived tables in SQL that both engines read -------------------------------------------

# Observations with unreadable numbers, missing cells, outliers and untidy class names.
OBS = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                 CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                 CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS row_key,
       CASE WHEN l_orderkey % 97 = 0 THEN 'n/a'
            ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS qty_raw,
       CASE WHEN l_partkey % 17 = 0 THEN NULL
            WHEN l_partkey % 211 = 0 THEN l_extendedprice * 4
            ELSE l_extendedprice END AS price,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL
            WHEN l_linestatus = 'O' THEN 'L' ELSE ' P ' END AS sex,
       CASE WHEN l_quantity <= 45 THEN 'Normal'
            WHEN l_quantity <= 49 THEN ' stunted' ELSE 'SEVERELY stunted ' END AS status
FROM lineitem"""

# The same observations without key and with coarse prices: most rows occur many times.
OBS_DUP = """
SELECT qty_raw, CAST(floor(price / 1000) AS BIGINT) AS price_k, sex, status FROM obs"""

# Imbalanced four-class table with two numeric features and a binary one.
IMB = """
SELECT l.doc_id AS id, l.quality * 2 + l.toxic AS label,
       CAST(d.n_chars AS DOUBLE) AS x1,
       CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS x2,
       CASE WHEN d.lang = 'en' THEN 1.0E0 ELSE 0.0E0 END AS x3
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

EVT = "SELECT event_id AS id, user_id, event_type AS label_name, value FROM events"

FEATURES = ["x1", "x2", "x3"]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = OBS.replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


def obs_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS_DUP.replace("FROM obs", "FROM {obs}"), obs=obs(spark, sf_dir))


def imb(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = IMB.replace("FROM labels", "FROM {labels}").replace("JOIN documents", "JOIN {documents}")
    return spark.sql(
        text, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents")
    )


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVT.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


# --- derived tables that need each engine's own syntax --------------------------------------

# DuckDB twin of functions.portable.uniform over a text expression.
def duck_uniform(tag: str, *keys: str) -> str:
    joined = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (
        f"(CAST(CAST('0x' || substr(md5(concat_ws(':', '42', '{tag}', {joined})), 1, 13) AS BIGINT)"
        " AS DOUBLE) / 4503599627370496)"
    )


def duck_hash(tag: str, *keys: str) -> str:
    joined = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws(':', '42', '{tag}', {joined}))"


# Predictions over imb, about one in five wrong.
PRED = f"""
SELECT id, label, x1, x2, x3, {duck_uniform('pred', 'id')} AS u,
       CASE WHEN {duck_uniform('pred', 'id')} < 0.8E0 THEN label
            ELSE (label + 1) % 4 END AS prediction
FROM imb"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = portable.uniform("pred", "id")
    wrong = (F.col("label") + 1) % 4
    return (
        imb(spark, sf_dir)
        .withColumn("u", u)
        .withColumn("prediction", F.when(F.col("u") < 0.8, F.col("label")).otherwise(wrong))
    )


# Runs of several models over all observations. A run errs on a row when the row's hash, shifted
# per run, is below its rate; the rare classes are four times as hard. (model, smote, rate)
RUNS = [
    ("Boosted Trees Preset", "none", 0.02),
    ("Random Forest", "none", 0.03),
    ("Gradient Boosting", "none", 0.025),
    ("KNN", "none", 0.04),
    ("Decision Tree", "none", 0.05),
    ("SVM", "none", 0.06),
    ("Logistic Regression", "none", 0.07),
    ("Naive Bayes", "none", 0.08),
    ("Boosted Trees Preset", "smote_k3", 0.03),
    ("Random Forest", "smote_k3", 0.02),
    ("Gradient Boosting", "smote_k3", 0.021),
    ("KNN", "smote_k3", 0.035),
    ("Decision Tree", "smote_k3", 0.045),
    ("SVM", "smote_k3", 0.05),
    ("Logistic Regression", "smote_k3", 0.12),
    ("Naive Bayes", "smote_k3", 0.3),
    ("Majority Vote", "none", 0.035),
]

# Candidates of a cross-validated search over all observations.
# (candidate, depth, split, leaf, smoothing, shift, rate); 3 and 4 predict alike.
CANDIDATES = [
    (0, 3, 2, 1, 1e-12, 1, 0.10),
    (1, 3, 5, 2, 1e-11, 2, 0.09),
    (2, 5, 2, 1, 1e-10, 3, 0.08),
    (3, 5, 5, 2, 1e-09, 4, 0.04),
    (4, 7, 2, 1, 1e-08, 4, 0.04),
    (5, 7, 5, 2, 1e-07, 6, 0.05),
    (6, 10, 2, 1, 1e-06, 7, 0.06),
    (7, 10, 5, 2, 1e-05, 8, 0.07),
    (8, None, 2, 1, 1e-04, 9, 0.11),
    (9, None, 5, 2, 1e-03, 10, 0.12),
]
FOLDS = 5

_WORD = 4294967296


def hashed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, h): class 0..2 and a 32-bit hash for every observation."""
    y = F.when(F.col("status") == "Normal", 0).when(F.col("status") == " stunted", 1).otherwise(2)
    h = F.conv(F.substring(F.md5("row_key"), 1, 8), 16, 10).cast("long")
    return obs(spark, sf_dir).select(y.alias("y"), h.alias("h"))


_DUCK_LABELS = """
labelled AS (SELECT CASE status WHEN 'Normal' THEN 0 WHEN ' stunted' THEN 1 ELSE 2 END AS y,
                    CAST('0x' || substr(md5(row_key), 1, 8) AS BIGINT) AS h FROM obs)"""

_MISS = "(h * (2 * shift + 3) + 7919 * shift) % 4294967296 < rate * 4294967296 * CASE WHEN y = 0 THEN 1 ELSE 4 END"


def _guess():
    place = (F.col("h") * (F.col("shift") * 2 + 3) + F.col("shift") * 7919) % F.lit(_WORD)
    hard = F.when(F.col("y") == 0, 1).otherwise(4)
    miss = place.cast("double") < F.col("rate") * F.lit(float(_WORD)) * hard
    return F.when(miss, (F.col("y") + 1) % 3).otherwise(F.col("y"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, smote, y, p) for every observation and run."""
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(s).alias("smote"),
                F.lit(i).cast("long").alias("shift"),
                F.lit(r).alias("rate"),
            )
            for i, (m, s, r) in enumerate(RUNS)
        ]
    )
    rows = hashed_labels(spark, sf_dir).select("y", "h", F.inline(cells))
    return rows.select("model", "smote", "y", _guess().alias("p"))


def _values(rows) -> str:
    def cell(v) -> str:
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else str(v))

    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


_RUN_ROWS = _values([(m, s, i, r) for i, (m, s, r) in enumerate(RUNS)])

DUCK_RUNS = f"""{_DUCK_LABELS},
runlist(model, smote, shift, rate) AS (VALUES {_RUN_ROWS}),
runs AS (SELECT model, smote, y, CASE WHEN {_MISS} THEN (y + 1) % 3 ELSE y END AS p
         FROM labelled CROSS JOIN runlist)"""


def duck_report(source: str, actual: str, predicted: str, by: str) -> str:
    """CTEs cm, cls, report and metrics over a label and a prediction column."""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
cm AS (SELECT {lead}{actual} AS actual, {predicted} AS predicted, count(*) AS n
       FROM {source} GROUP BY {lead}{actual}, {predicted}),
cls AS (SELECT {lead}class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(s) AS BIGINT) AS support,
               CAST(sum(g) AS BIGINT) AS guessed
        FROM (SELECT {lead}actual AS class, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp,
                     n AS s, 0 AS g FROM cm
              UNION ALL SELECT {lead}predicted, 0, 0, n FROM cm) GROUP BY {lead}class),
report AS (SELECT {lead}class, tp, support, guessed,
                  CASE WHEN guessed = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / guessed END AS "precision",
                  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS recall,
                  CASE WHEN support + guessed = 0 THEN 0.0::DOUBLE
                       ELSE 2 * tp::DOUBLE / (support + guessed) END AS f1 FROM cls),
metrics AS (SELECT {lead}sum(tp)::DOUBLE / sum(support) AS accuracy,
                   sum("precision" * support) / sum(support) AS precision_w,
                   sum(recall * support) / sum(support) AS recall_w,
                   sum(f1 * support) / sum(support) AS f1 FROM report {group})"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run. The area is that of the hard labels; SVM runs have none."""
    by = ["model", "smote"]
    counts = evaluate.confusion_counts(runs(spark, sf_dir), "y", "p", by)
    metrics = evaluate.weighted_from_counts(counts, by)
    parts = evaluate.per_class(counts, by)
    total = parts.groupBy(*by).agg(F.sum("support").alias("total"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    false_alarm = F.try_divide(
        (F.col("predicted_n") - F.col("tp")).cast("double"), (F.col("total") - F.col("support")).cast("double")
    )
    area = parts.join(total, by).groupBy(*by).agg(
        F.avg((recall + F.lit(1.0) - false_alarm) / F.lit(2.0)).alias("a")
    )
    shown = F.when(F.col("model") != "SVM", F.bround("a", 4))
    rounded = [F.bround(c, 4).alias(c) for c in ("accuracy", "precision_w", "recall_w", "f1")]
    return metrics.join(area, by).select(*by, *rounded, shown.alias("roc_auc"))


DUCK_RESULTS = f"""{DUCK_RUNS},
{duck_report('runs', 'y', 'p', 'model, smote')},
areas AS (SELECT model, smote,
                 avg((tp::DOUBLE / support + 1 - (guessed - tp)::DOUBLE / (total - support)) / 2) AS a
          FROM (SELECT *, sum(support) OVER (PARTITION BY model, smote) AS total FROM cls)
          GROUP BY model, smote),
results AS (SELECT model, smote, round_even(accuracy, 4) AS accuracy,
                   round_even(precision_w, 4) AS precision_w, round_even(recall_w, 4) AS recall_w,
                   round_even(f1, 4) AS f1,
                   CASE WHEN model <> 'SVM' THEN round_even(a, 4) END AS roc_auc
            FROM metrics JOIN areas USING (model, smote))"""


def fold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, fold, y, p) for every observation and candidate."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c[0]).alias("candidate_id"), F.lit(c[5]).cast("long").alias("shift"), F.lit(c[6]).alias("rate")
            )
            for c in CANDIDATES
        ]
    )
    fold = (F.col("h") % F.lit(FOLDS)).cast("int").alias("fold")
    rows = hashed_labels(spark, sf_dir).select("y", "h", fold, F.inline(cells))
    return rows.select("candidate_id", "fold", "y", _guess().alias("p"))


def candidate_params(spark: SparkSession) -> DataFrame:
    rows = [
        (c[0], {"max_depth": None if c[1] is None else str(c[1]), "min_samples_split": str(c[2]),
                "min_samples_leaf": str(c[3]), "var_smoothing": repr(c[4])})
        for c in CANDIDATES
    ]
    return spark.createDataFrame(rows, "candidate_id int, params map<string,string>")


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, fold, score)."""
    by = ["candidate_id", "fold"]
    counts = evaluate.confusion_counts(fold_runs(spark, sf_dir), "y", "p", by)
    scored = evaluate.weighted_from_counts(counts, by)
    return scored.select(*by, F.bround("f1", 6).alias("score"))


_CANDIDATE_ROWS = _values([(c[0], c[1], c[2], c[3], c[4], c[5], c[6]) for c in CANDIDATES])


def duck_cv(scores: str, folds: int = FOLDS) -> str:
    """CTE cv over (candidate_id, fold, score)."""
    cols = [f"max(CASE WHEN fold = {f} THEN score END) AS split{f}" for f in range(folds)]
    plus = " + ".join(f"split{f}" for f in range(folds))
    gaps = " + ".join(f"(split{f} - mean) * (split{f} - mean)" for f in range(folds))
    return f"""
wide AS (SELECT candidate_id, {', '.join(cols)} FROM {scores} GROUP BY candidate_id),
meant AS (SELECT *, ({plus}) / {folds} AS mean FROM wide),
cv AS (SELECT *, sqrt(({gaps}) / {folds}) AS std,
              CAST(rank() OVER (ORDER BY mean DESC) AS INTEGER) AS rank FROM meant)"""


DUCK_CV = f"""{_DUCK_LABELS},
candlist(candidate_id, depth, split, leaf, smoothing, shift, rate) AS (VALUES {_CANDIDATE_ROWS}),
fold_runs AS (SELECT candidate_id, h % {FOLDS} AS fold, y,
                     CASE WHEN {_MISS} THEN (y + 1) % 3 ELSE y END AS p
              FROM labelled CROSS JOIN candlist),
{duck_report('fold_runs', 'y', 'p', 'candidate_id, fold')},
fold_scores AS (SELECT candidate_id, fold, round_even(f1, 6) AS score FROM metrics),
{duck_cv('fold_scores')}"""

DUCK = {
    "obs": f"obs AS ({OBS})",
    "obs_dup": f"obs_dup AS ({OBS_DUP})",
    "imb": f"imb AS ({IMB})",
    "evt": f"evt AS ({EVT})",
    "pred": f"pred AS ({PRED})",
    "results": DUCK_RESULTS.strip(),
    "runs": DUCK_RUNS.strip(),
    "cv": DUCK_CV.strip(),
}
_NEEDS = {"obs_dup": ["obs"], "pred": ["imb"], "results": ["obs"], "runs": ["obs"], "cv": ["obs"]}


def duck(*names: str, then: str = "") -> str:
    """``WITH`` clause of the named derived tables and further CTEs."""
    wanted: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    parts = [DUCK[x] for x in wanted] + ([then.strip()] if then else [])
    return "WITH " + ",\n".join(parts) + "\n"


# DuckDB: strip all outer whitespace; capital after any non-letter.
DUCK_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
DUCK_TITLE = (
    "array_to_string(list_transform(string_split({c}, ''), lambda ch, i: CASE WHEN i = 1 OR NOT "
    "regexp_matches(string_split({c}, '')[i - 1], '\\p{{L}}') THEN upper(ch) ELSE lower(ch) END), '')"
)


def duck_strip(c: str) -> str:
    return DUCK_STRIP.format(c=c)


def duck_title(c: str) -> str:
    return DUCK_TITLE.format(c=duck_strip(c))


def r6(c, name: str):
    """Rounded to 6 places, half-even, under its own name."""
    return F.bround(c, 6).alias(name)
