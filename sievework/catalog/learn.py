"""Splits, resampling, classifiers, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.catalog.base import (
    FEATURES,
    duck,
    duck_cv,
    duck_hash,
    duck_report,
    duck_uniform,
    imb,
    obs,
    query,
    r6,
    table,
)
from sievework.models import boosting, gnb, knn, mllib, trees
from sievework.models.registry import Problem, default_registry, gaussian_spec, nearest_spec, tree_spec
from sievework.operators import auc, neighbors, projected_neighbors, sampling, scale, smote
from sievework.plans import comparison, search
from sievework.session import materialize

PROBLEM = Problem(tuple(FEATURES), "label", "id", 4)

# --- split and folds ------------------------------------------------------------------------

_SPLIT = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {duck_hash('split', 'id')}, id) AS rk,
 count(*) OVER (PARTITION BY label) AS n_c, count(*) OVER () AS n FROM imb),
quota AS (SELECT DISTINCT label, n, n_c, ceil(0.2 * n) AS nt, n_c * ceil(0.2 * n) / n AS ex FROM ranked),
part AS (SELECT *, floor(ex) AS fl, row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS rr, sum(floor(ex)) OVER () AS sf FROM quota),
split AS (SELECT r.id, r.label, r.x1, r.x2, r.x3, CASE WHEN r.rk <= p.fl + CASE WHEN p.rr <= p.nt - p.sf THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS is_test
 FROM ranked r JOIN part p USING (label))"""


def _split(spark, sf):
    return sampling.stratified_split(imb(spark, sf), "label", ["id"])


@query("stratified_split", duck("imb", then=_SPLIT) + "SELECT id, label, is_test FROM split")
def stratified_split(spark, sf):
    return _split(spark, sf).select("id", "label", "is_test")


_SPLIT_OBS = f"""ranked AS (SELECT row_key, status, row_number() OVER (PARTITION BY status ORDER BY {duck_hash('split', 'row_key')}) AS rk,
 count(*) OVER (PARTITION BY status) AS n_c, count(*) OVER () AS n FROM obs),
quota AS (SELECT DISTINCT status, n, n_c, ceil(0.2 * n) AS nt, n_c * ceil(0.2 * n) / n AS ex FROM ranked),
part AS (SELECT *, floor(ex) AS fl, row_number() OVER (ORDER BY ex - floor(ex) DESC, status) AS rr, sum(floor(ex)) OVER () AS sf FROM quota)"""


@query(
    "stratified_split_large",
    duck("obs", then=_SPLIT_OBS)
    + """SELECT row_key, r.status, CASE WHEN r.rk <= p.fl + CASE WHEN p.rr <= p.nt - p.sf THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS is_test
FROM ranked r JOIN part p USING (status)""",
)
def stratified_split_large(spark, sf):
    """The split on the large table, where one class holds nine rows in ten."""
    rows = obs(spark, sf).select("row_key", "status")
    return sampling.stratified_split(rows, "status", ["row_key"])


def _folds(source: str, k: int = 5) -> str:
    """Per class, the rows of fold f are those dealt to it in class order; filled in hash order."""
    return f"""franked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {duck_hash('fold', 'id')}, id) AS fr FROM {source}),
dealt AS (SELECT label, (row_number() OVER (ORDER BY label) - 1) % {k} AS f FROM {source}),
taken AS (SELECT label, f, sum(count(*)) OVER (PARTITION BY label ORDER BY f) AS upto, sum(count(*)) OVER (PARTITION BY label ORDER BY f) - count(*) AS below
 FROM dealt GROUP BY label, f),
folded AS (SELECT r.*, CAST(t.f AS INTEGER) AS fold FROM franked r JOIN taken t ON r.label = t.label AND r.fr > t.below AND r.fr <= t.upto)"""


@query("stratified_kfold", duck("imb", then=_folds("imb")) + "SELECT id, label, fold FROM folded")
def stratified_kfold(spark, sf):
    folded = sampling.stratified_kfold(imb(spark, sf), "label", ["id"])
    return folded.select("id", "label", "fold")


# Classes of two orders: a class per part that has at least five line items.
_PARTS = """parts AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS label,
concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5)),
part_rows AS (SELECT label, id FROM parts GROUP BY label, id)"""


def _part_rows(spark, sf):
    lines = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    keys = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string"))
    rows = lines.select(F.col("l_partkey").alias("label"), keys.alias("id"))
    often = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("label")
    return materialize(rows.join(often, "label", "left_semi").distinct(), "part-rows")


_SPLIT_MANY = _SPLIT.replace("FROM imb)", "FROM part_rows)").replace("r.x1, r.x2, r.x3, ", "")


@query("stratified_split_many", f"WITH {_PARTS}, {_SPLIT_MANY} SELECT id, label, is_test FROM split")
def stratified_split_many(spark, sf):
    """The split with a class per part, through tables of class quotas as beyond 500,000 classes."""
    return sampling.stratified_split(_part_rows(spark, sf), "label", ["id"], most_classes=1000)


@query("stratified_kfold_many", f"WITH {_PARTS}, {_folds('part_rows')} SELECT id, label, fold FROM folded")
def stratified_kfold_many(spark, sf):
    return sampling.stratified_kfold(_part_rows(spark, sf), "label", ["id"], most_classes=1000)


# --- neighbours and resampling --------------------------------------------------------------


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in FEATURES)


@query(
    "knn_within_class",
    duck("imb")
    + f"""SELECT label, id, CAST(rank AS INTEGER) AS rank, neighbor, round_even(d2, 6) AS d2 FROM (
SELECT a.label, a.id, b.id AS neighbor, {_d2('a', 'b')} AS d2,
row_number() OVER (PARTITION BY a.id ORDER BY {_d2('a', 'b')}, b.id) AS rank
FROM imb a JOIN imb b ON a.label = b.label AND a.id <> b.id) WHERE rank <= 3""",
)
def knn_within_class(spark, sf):
    pairs = neighbors.knn_pairs(imb(spark, sf), FEATURES, "id", 3, ["label"])
    return pairs.withColumn("d2", F.bround("d2", 6))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(
    "knn_projected",
    f"""SELECT count(*) AS n_queries, count(*) * least(10, (SELECT count(*) FROM embeddings WHERE {_USABLE}) - 1) AS n_pairs,
TRUE AS exact_distances, TRUE AS recalled FROM embeddings WHERE vec_id % 20 = 0 AND {_USABLE}""",
)
def knn_projected(spark, sf):
    """Ten nearest of all vectors for every row with an id divisible by 20, held to the exact search.

    ``recalled``: at least nine tenths of the true neighbours are found; ``exact_distances``: those found have the
    distance that the exact search gives."""
    vectors = table(spark, sf, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.where((F.size("embedding") > 0) & finite)
    wanted = F.col("vec_id") % 20 == 0
    found = materialize(
        projected_neighbors.approx_neighbors(vectors, vectors.where(wanted), "embedding", "vec_id", 10), "projected"
    )
    first = usable.select(F.size("embedding").alias("n")).first()
    xs = [f"v{i}" for i in range(first["n"] if first else 0)]
    wide = materialize(usable.select("vec_id", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(xs)]), "wide")
    asked = wide.where(wanted)
    lists = neighbors.neighbor_lists(wide, asked, xs, "vec_id", 11)
    near = neighbors.attach_neighbors(asked, lists, xs, "vec_id").select("vec_id", "neighbors")
    others = F.slice(F.filter("neighbors", lambda s: s["key"] != F.col("vec_id")), 1, 10)
    exact = near.select("vec_id", F.explode(others).alias("s")).select("vec_id", F.col("s.key").alias("neighbor"), F.col("s.d2").alias("true_d2"))
    both = found.join(exact, ["vec_id", "neighbor"], "left")
    sums = both.agg(
        F.count_distinct("vec_id").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"), F.count("true_d2").alias("hit"),
        F.bool_and(F.coalesce(F.abs(F.col("d2") - F.col("true_d2")) <= 1e-9, F.lit(True))).alias("exact_distances"),
    )
    recalled = F.col("hit") >= 0.9 * F.col("n_pairs")
    return sums.select("n_queries", "n_pairs", "exact_distances", recalled.alias("recalled"))


def _smote(source: str, within: str = "") -> str:
    """CTE resampled(within, label, x1, x2, x3, number) over source."""
    lead = f"{within}, " if within else ""
    keys = [within] if within else []
    both = f"{lead}label"
    match = " AND ".join(f"a.{c} = b.{c}" for c in [*keys, "label"])
    size = f"PARTITION BY {within}" if within else ""

    def u(tag: str) -> str:
        return duck_uniform(tag, *keys, "label", "i")

    order = duck_hash("smote", *keys, "label", "id")
    lead_m = "".join(f"m.{k}, " for k in keys)
    mixed = ", ".join(f"b.{x} + m.gap * (n.{x} - b.{x}) AS {x}" for x in FEATURES)
    at = " AND ".join(f"b.{c} = m.{c}" for c in [*keys, "label"])
    return f"""csize AS (SELECT {both}, count(*) AS n_c FROM {source} GROUP BY {both}),
cneed AS (SELECT *, max(n_c) OVER ({size}) - n_c AS need FROM csize),
minority AS (SELECT s.* FROM {source} s JOIN cneed USING ({both}) WHERE need > 0),
near AS (SELECT * FROM (SELECT a.*, b.id AS nid, row_number() OVER (PARTITION BY {"a." + within + ", " if within else ""}a.label, a.id ORDER BY {_d2('a', 'b')}, b.id) AS nr
 FROM minority a JOIN minority b ON {match} AND a.id <> b.id) WHERE nr <= 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {both} ORDER BY {order}) - 1 AS bi FROM minority),
made AS (SELECT {both}, i, n_c, CAST(floor({u('base')} * n_c) AS BIGINT) AS bi, CAST(floor({u('nn')} * 3) AS BIGINT) + 1 AS nr, {u('gap')} AS gap
 FROM (SELECT {both}, n_c, unnest(range(need)) AS i FROM cneed WHERE need > 0)),
resampled AS (SELECT {lead}label, x1, x2, x3, NULL::BIGINT AS number FROM {source}
 UNION ALL SELECT {lead_m}m.label, {mixed}, m.i FROM made m JOIN numbered b ON {at} AND b.bi = m.bi
 JOIN near r ON {' AND '.join(f'r.{c} = m.{c}' for c in [*keys, 'label'])} AND r.id = b.id AND r.nr = m.nr
 JOIN minority n ON {' AND '.join(f'n.{c} = m.{c}' for c in [*keys, 'label'])} AND n.id = r.nid)"""


_X6 = ", ".join(f"round_even({x}, 6) AS {x}" for x in FEATURES)


def _rounded(df):
    return df.withColumns({x: F.bround(x, 6) for x in FEATURES})


@query(
    "smote_oversample",
    duck("imb", then=_smote("imb")) + f"SELECT label, {_X6}, number FROM resampled",
)
def smote_oversample(spark, sf):
    return _rounded(smote.smote(imb(spark, sf), FEATURES, "label", "id")).drop("id")


_TRAINING = """ftrain AS (SELECT id, label, x1, x2, x3, CAST(t.f AS INTEGER) AS left_out FROM folded, range(5) AS t(f) WHERE t.f <> fold)"""


@query(
    "smote_per_fold",
    duck("imb", then=",\n".join([_folds("imb"), _TRAINING, _smote("ftrain", "left_out")]))
    + f"SELECT left_out, label, {_X6}, number FROM resampled",
)
def smote_per_fold(spark, sf):
    """The balanced training rows of each fold."""
    folded = sampling.stratified_kfold(imb(spark, sf), "label", ["id"])
    balanced = smote.smote_per_fold(folded, FEATURES, "label", "id", 5)
    return _rounded(balanced).select("left_out", "label", *FEATURES, "number")


@query(
    "resample_effect",
    duck("imb") + "SELECT label, count(*) AS n_before, max(count(*)) OVER () AS n_after FROM imb GROUP BY label",
)
def resample_effect(spark, sf):
    rows = imb(spark, sf)
    return smote.resample_effect(rows, smote.smote(rows, FEATURES, "label", "id"), "label")


# --- classifiers in SQL ---------------------------------------------------------------------

_TRAIN = _SPLIT + ",\ntrain AS (SELECT * FROM split WHERE is_test = 0),\ntest AS (SELECT * FROM split WHERE is_test = 1)"


def _train_test(spark, sf):
    """Both parts of the split, which is made once however many passes a model takes."""
    split = materialize(_split(spark, sf), "split", ["is_test"])
    return sampling.train_part(split), sampling.test_part(split)


def _gnb_fit(source: str = "train", within: str = "") -> str:
    lead = f"{within}, " if within else ""
    group = f"GROUP BY {within}" if within else ""
    stats = ", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in FEATURES)
    widest = "greatest(" + ", ".join(f"var_pop({x})" for x in FEATURES) + ")"
    return f"""gstat AS (SELECT {lead}label AS c, count(*) AS n, {stats} FROM {source} GROUP BY {lead}label),
gwide AS (SELECT {lead}count(*) AS total, {widest} AS widest FROM {source} {group})"""


def _gnb_score(row: str, smoothing: str) -> str:
    """log prior and likelihood of a row against one class row g, with w the overall row."""
    terms = " + ".join(
        f"(ln(2 * pi() * (g.v_{x} + {smoothing} * w.widest)) + ({row}.{x} - g.m_{x}) * ({row}.{x} - g.m_{x}) / (g.v_{x} + {smoothing} * w.widest))"
        for x in FEATURES
    )
    return f"ln(g.n::DOUBLE / w.total) - 0.5::DOUBLE * ({terms})"


@query(
    "gnb_fit",
    duck("imb", then=",\n".join([_TRAIN, _gnb_fit()]))
    + "\nUNION ALL ".join(
        f"SELECT c AS class, '{x}' AS feature, n, round_even(n::DOUBLE / total, 6) AS prior, round_even(m_{x}, 6) AS mean, round_even(v_{x} + 1e-9::DOUBLE * widest, 6) AS variance FROM gstat, gwide"
        for x in FEATURES
    ),
)
def gnb_fit(spark, sf):
    train, _ = _train_test(spark, sf)
    found = gnb.fit_table(train, gnb.fit(train, FEATURES, "label"))
    return found.select(
        F.col("class").cast("int").alias("class"), "feature", "n", *[r6(c, c) for c in ("prior", "mean", "variance")]
    )


def _gnb_predict(smoothing: str = "1e-9::DOUBLE") -> str:
    return f"""guess AS (SELECT id, label, arg_max(c, (s, -c)) AS prediction FROM (
SELECT t.id, t.label, g.c, {_gnb_score('t', smoothing)} AS s FROM test t, gstat g, gwide w) GROUP BY id, label)"""


_GNB_PREDICT = _gnb_predict()


@query(
    "gnb_predict",
    duck("imb", then=",\n".join([_TRAIN, _gnb_fit(), _GNB_PREDICT])) + "SELECT id, label, prediction FROM guess",
)
def gnb_predict(spark, sf):
    train, test = _train_test(spark, sf)
    out = gnb.predict(test, gnb.fit(train, FEATURES, "label"))
    return out.select("id", "label", "prediction")


_SMOOTHINGS = search.NB_GRID["var_smoothing"]
_NB_SCORES = f"""ll AS (SELECT t.id, g.c, {_gnb_score('t', '1e-9::DOUBLE')} AS s FROM test t, gstat g, gwide w),
grown AS (SELECT id, c, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM ll),
scores AS (SELECT id, {', '.join(f'max(CASE WHEN c = {c} THEN e END) / sum(e) AS score_{c}' for c in range(4))} FROM grown GROUP BY id)"""
_SCORES6 = ", ".join(f"round_even(score_{c}, 6) AS score_{c}" for c in range(4))


@query(
    "gnb_scores",
    duck("imb", then=",\n".join([_TRAIN, _gnb_fit(), _NB_SCORES])) + f"SELECT id, {_SCORES6} FROM scores",
)
def gnb_scores(spark, sf):
    """Class probabilities of a fitted naive Bayes model."""
    train, test = _train_test(spark, sf)
    out = gaussian_spec().fit(train, PROBLEM).predict(test)
    return out.select("id", *[r6(f"score_{c}", f"score_{c}") for c in PROBLEM.classes])


_SMOOTH_ROWS = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_SMOOTHINGS))


@query(
    "gnb_var_smoothing",
    duck("imb", then=",\n".join([_TRAIN, _gnb_fit()]))
    + f"""SELECT id, candidate_id, arg_max(c, (s, -c)) AS prediction FROM (
SELECT t.id, v.candidate_id, g.c, {_gnb_score('t', 'v.smoothing')} AS s
FROM test t, gstat g, gwide w, (VALUES {_SMOOTH_ROWS}) AS v(candidate_id, smoothing)) GROUP BY id, candidate_id""",
)
def gnb_var_smoothing(spark, sf):
    train, test = _train_test(spark, sf)
    model = gnb.fit(train, FEATURES, "label")
    out = gnb.predict_smoothings(test, model, dict(enumerate(_SMOOTHINGS)))
    return out.select("id", "candidate_id", "prediction")


_SCALED = "".join(
    f"""CASE WHEN s_{x} = 0 THEN ({a}.{x} - m_{x}) ELSE ({a}.{x} - m_{x}) / s_{x} END AS {x}, """
    for a in ["r"]
    for x in FEATURES
).rstrip(", ")
_KNN = f"""fit AS (SELECT {', '.join(f'round(avg({x}), 9) AS m_{x}, round(stddev_pop({x}), 9) AS s_{x}' for x in FEATURES)} FROM train),
strain AS (SELECT id, label, {_SCALED} FROM train r, fit),
stest AS (SELECT id, label, {_SCALED} FROM test r, fit),
votes AS (SELECT id, label, vote, count(*) AS n FROM (SELECT a.id, a.label, b.label AS vote,
 row_number() OVER (PARTITION BY a.id ORDER BY {_d2('a', 'b')}, b.id) AS rn FROM stest a, strain b) WHERE rn <= 5 GROUP BY id, label, vote)"""


@query(
    "knn_classify",
    duck("imb", then=",\n".join([_TRAIN, _KNN]))
    + "SELECT id, label, arg_max(vote, (n, -vote)) AS prediction FROM votes GROUP BY id, label",
)
def knn_classify(spark, sf):
    train, test = _train_test(spark, sf)
    fit = scale.fit_scaler(train, FEATURES, digits=9)
    out = knn.classify(
        scale.apply_scaler(train, fit), scale.apply_scaler(test, fit), FEATURES, "label", "id", [0, 1, 2, 3]
    )
    return out.select("id", "label", "prediction")


@query(
    "knn_scores",
    duck("imb", then=",\n".join([_TRAIN, _KNN]))
    + "SELECT id, "
    + ", ".join(f"coalesce(sum(CASE WHEN vote = {c} THEN n END), 0)::DOUBLE / sum(n) AS score_{c}" for c in range(4))
    + " FROM votes GROUP BY id",
)
def knn_scores(spark, sf):
    """Vote shares of the k nearest neighbours."""
    train, test = _train_test(spark, sf)
    fit = scale.fit_scaler(train, FEATURES, digits=9)
    model = nearest_spec().fit(scale.apply_scaler(train, fit), PROBLEM)
    out = model.predict(scale.apply_scaler(test, fit))
    return out.select("id", *[f"score_{c}" for c in PROBLEM.classes])


_AUC = """auc AS (SELECT CASE WHEN count(a) = 4 THEN avg(a) END AS roc_auc FROM (
 SELECT k.c, sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS a
 FROM (VALUES (0), (1), (2), (3)) AS k(c)
 JOIN sc p ON p.c = k.c AND p.label = k.c JOIN sc q ON q.c = k.c AND q.label <> k.c GROUP BY k.c))"""
_SHOWN = ["accuracy", "precision_w", "recall_w", "f1"]


def _nb_run(source: str) -> str:
    """Metrics and area of naive Bayes fitted on a table and asked about the test rows."""
    scored = "sc AS (SELECT t.id, t.label, l.c, l.e / sum(l.e) OVER (PARTITION BY l.id) AS s FROM grown l JOIN test t USING (id))"
    return ",\n".join(
        [_gnb_fit(source), _GNB_PREDICT, _NB_SCORES, scored, _AUC, duck_report("guess", "label", "prediction", "").strip()]
    )


@query(
    "evaluate_nb",
    duck("imb", then=",\n".join([_TRAIN, _nb_run("train")]))
    + "SELECT 'Naive Bayes' AS model, 'none' AS smote, "
    + ", ".join(f"round_even({m}, 4) AS {m}" for m in _SHOWN)
    + ", (SELECT round_even(roc_auc, 4) FROM auc) AS roc_auc FROM metrics",
)
def evaluate_nb(spark, sf):
    """Fit, predict and score naive Bayes in one call; the two times are left out."""
    train, test = _train_test(spark, sf)
    found = comparison.evaluate_model(gaussian_spec(), train, test, PROBLEM).metrics
    return found.select("model", "smote", *_SHOWN, "roc_auc")


@query(
    "evaluate_nb_smote",
    duck("imb", then=",\n".join([_TRAIN, _smote("train"), _nb_run("resampled")]))
    + "SELECT 'Naive Bayes' AS model, 'smote_k3' AS smote, "
    + ", ".join(f"round_even({m}, 4) AS {m}" for m in _SHOWN)
    + " FROM metrics",
)
def evaluate_nb_smote(spark, sf):
    """The same on resampled training rows."""
    train, test = _train_test(spark, sf)
    balanced = smote.materialized_smote(train, FEATURES, "label", "id", k=3)
    found = comparison.evaluate_model(gaussian_spec(), balanced, test, PROBLEM, "smote_k3").metrics
    return found.select("model", "smote", *_SHOWN)


_RUN_SCORES = f"""nbs AS (SELECT 'Naive Bayes' AS model, s.*, t.label FROM scores s JOIN test t USING (id)),
knns AS (SELECT 'KNN' AS model, id, {", ".join(f"coalesce(sum(CASE WHEN vote = {c} THEN n END), 0)::DOUBLE / sum(n) AS score_{c}" for c in range(4))}, any_value(label) AS label
 FROM votes GROUP BY id),
runs AS (SELECT * FROM nbs UNION ALL BY NAME SELECT * FROM knns),
sc AS (SELECT model, label, c, [score_0, score_1, score_2, score_3][c + 1] AS s FROM runs, range(4) AS k(c))"""


@query(
    "roc_auc_runs",
    duck("imb", then=",\n".join([_TRAIN, _gnb_fit(), _NB_SCORES, _KNN, _RUN_SCORES]))
    + """SELECT model, round_even(avg(a), 6) AS roc_auc FROM (
SELECT p.model, p.c, sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS a
FROM sc p JOIN sc q ON p.model = q.model AND p.c = q.c AND p.label = p.c AND q.label <> q.c GROUP BY p.model, p.c) GROUP BY model""",
)
def roc_auc_runs(spark, sf):
    """The areas of several models' scores in the same jobs."""
    train, test = _train_test(spark, sf)
    fit = scale.fit_scaler(train, FEATURES, digits=9)
    scaled = scale.apply_scaler(train, fit), scale.apply_scaler(test, fit)
    runs = None
    for spec, (a, b) in ((gaussian_spec(), (train, test)), (nearest_spec(), scaled)):
        own = spec.fit(a, PROBLEM).predict(b)
        own = own.select(F.lit(spec.name).alias("model"), "label", *[f"score_{c}" for c in PROBLEM.classes])
        runs = own if runs is None else runs.unionByName(own)
    found = auc.roc_auc_ovr(materialize(runs, "runs"), "label", {c: f"score_{c}" for c in PROBLEM.classes}, by=["model"])
    return found.select("model", r6("roc_auc", "roc_auc"))


# --- classifiers from MLlib -----------------------------------------------------------------


def _predicted(model, test):
    return model.predict(test).select("id", "label", F.col("prediction").cast("int").alias("prediction"))


def _scaled(spark, sf):
    train, test = _train_test(spark, sf)
    fit = scale.fit_scaler(train, FEATURES)
    return scale.apply_scaler(train, fit), scale.apply_scaler(test, fit)


@query("dt_default")
def dt_default(spark, sf):
    train, test = _train_test(spark, sf)
    return _predicted(mllib.fit_decision_tree(train, FEATURES, "label", 4), test)


@query("dt_tuned")
def dt_tuned(spark, sf):
    """Best published settings, on resampled training rows."""
    train, test = _train_test(spark, sf)
    balanced = smote.materialized_smote(train, FEATURES, "label", "id", k=3)
    tries = search.max_features("sqrt", len(FEATURES))
    return _predicted(mllib.fit_decision_tree(balanced, FEATURES, "label", 4, "gini", None, 1, tries), test)


@query("random_forest")
def random_forest(spark, sf):
    train, test = _train_test(spark, sf)
    return _predicted(mllib.fit_random_forest(train, FEATURES, "label", 4), test)


@query("logreg_ovr")
def logreg_ovr(spark, sf):
    train, test = _scaled(spark, sf)
    return _predicted(mllib.fit_logistic_ovr(train, FEATURES, "label", 4), test)


@query("svm_rff")
def svm_rff(spark, sf):
    train, test = _scaled(spark, sf)
    return _predicted(mllib.fit_svm_rff(train, FEATURES, "label", 4), test)


@query("gbt_ovr")
def gbt_ovr(spark, sf):
    train, test = _train_test(spark, sf)
    """Boosted trees of all classes at once; the key's name is kept from one-vs-rest times."""
    return _predicted(boosting.fit_boosted(train, FEATURES, "label", 4), test)


@query("gbt_preset")
def gbt_preset(spark, sf):
    train, test = _train_test(spark, sf)
    return _predicted(boosting.fit_boosted(train, FEATURES, "label", 4, boosting.PRESET), test)


_FACTS = ("Decision Tree", "Random Forest", "Logistic Regression", "Gradient Boosting", "Boosted Trees Preset")
_FACT_ROWS = ", ".join(f"('{name}')" for name in _FACTS)


@query(
    "model_facts",
    duck("imb", then=_TRAIN)
    + f"""SELECT model, (SELECT count(*) FROM test) AS n_test, (SELECT count(*) FROM test) AS n_scored, true AS beats_majority
FROM (VALUES {_FACT_ROWS}) AS m(model)""",
)
def model_facts(spark, sf):
    """What must hold of every fitted model: a prediction and scores that add up to 1 for each test row, and at least
    the largest class's share of the training rows right."""
    found = []
    train, test = _train_test(spark, sf)
    largest = train.groupBy("label").count().agg(F.max("count")).first()[0]
    fit = scale.fit_scaler(train, FEATURES)
    specs = {s.name: s for s in default_registry()}
    for name in _FACTS:
        scaled = specs[name].use_scaling
        a, b = (scale.apply_scaler(train, fit), scale.apply_scaler(test, fit)) if scaled else (train, test)
        model = specs[name].fit(a, PROBLEM)
        total = sum((F.col(f"score_{c}") for c in range(1, 4)), F.col("score_0"))
        known = F.col("prediction").isin([float(c) for c in range(4)])
        own = model.predict(b).agg(F.count_if(known).alias("n_test"), F.count_if(F.abs(total - 1) < 1e-6).alias("n_scored"))
        hits = model.predict(a).agg(F.count_if(F.col("prediction") == F.col("label"))).first()[0]
        found.append(own.select(F.lit(name).alias("model"), "n_test", "n_scored", F.lit(hits >= largest).alias("beats_majority")))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


@query("evaluate_model")
def evaluate_model(spark, sf):
    """Fit, predict, time and score one decision tree."""
    train, test = _train_test(spark, sf)
    return comparison.evaluate_model(tree_spec(), train, test, PROBLEM).metrics


@query("compare_models")
def compare_models(spark, sf):
    """All eight models with and without resampling."""
    train, test = _train_test(spark, sf)
    return comparison.compare_models(train, test, PROBLEM, default_registry())


# --- searches -------------------------------------------------------------------------------

_NB = search.NB_GRID["var_smoothing"]
_NB_ROWS = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_NB))
_GRID = ",\n".join(
    [
        _TRAIN,
        _folds("train"),
        _TRAINING,
        _smote("ftrain", "left_out"),
        _gnb_fit("resampled", "left_out"),
        f"""cand(candidate_id, smoothing) AS (VALUES {_NB_ROWS}),
cvpred AS (SELECT candidate_id, fold, label AS y, arg_max(c, (s, -c)) AS p FROM (
 SELECT v.candidate_id, t.fold, t.id, t.label, g.c, {_gnb_score('t', 'v.smoothing')} AS s
 FROM folded t JOIN gstat g ON g.left_out = t.fold JOIN gwide w ON w.left_out = t.fold, cand v)
 GROUP BY candidate_id, fold, id, label)""",
        duck_report("cvpred", "y", "p", "candidate_id, fold").strip(),
        "scores AS (SELECT candidate_id, fold, round_even(f1, 12) AS score FROM metrics)",
        duck_cv("scores").strip(),
    ]
)


def _rounded_cv(cv):
    return cv.withColumns({c: F.bround(c, 6) for c in cv.columns if c not in ("candidate_id", "rank")})


@query(
    "grid_search_gnb",
    duck("imb", then=_GRID)
    + "SELECT candidate_id, "
    + ", ".join(f"round_even(split{f}, 6) AS split{f}" for f in range(5))
    + ", round_even(mean, 6) AS mean, round_even(std, 6) AS std, rank FROM cv",
)
def grid_search_gnb(spark, sf):
    train, _ = _train_test(spark, sf)
    prepared = search.prepare_folds(train, FEATURES, "label", "id")
    return _rounded_cv(search.search_gnb(prepared, FEATURES, "label"))


_BEST = f"""best AS (WITH {_GRID} SELECT c.smoothing FROM cv JOIN cand c USING (candidate_id) ORDER BY rank, candidate_id LIMIT 1)"""


@query(
    "experiment_tuned_nb",
    duck(
        "imb",
        then=",\n".join(
            [
                _BEST,
                _TRAIN,
                _smote("train"),
                _gnb_fit("resampled"),
                _gnb_predict("(SELECT smoothing FROM best)"),
                duck_report("guess", "label", "prediction", "").strip(),
            ]
        ),
    )
    + "SELECT 'Naive Bayes' AS model, 'smote_k3' AS smote, (SELECT smoothing FROM best) AS var_smoothing, "
    + ", ".join(f"round_even({m}, 4) AS {m}" for m in _SHOWN)
    + " FROM metrics",
)
def experiment_tuned_nb(spark, sf):
    """Naive Bayes tuned on resampled folds, refitted on resampled rows, asked about the test rows."""
    train, test = _train_test(spark, sf)
    prepared = search.prepare_folds(train, FEATURES, "label", "id")
    spec, smoothing = comparison.tuned_gaussian(train, prepared, PROBLEM)
    balanced = smote.materialized_smote(train, FEATURES, "label", "id", k=3)
    found = comparison.evaluate_model(spec, balanced, test, PROBLEM, "smote_k3").metrics
    return found.select("model", "smote", F.lit(smoothing).alias("var_smoothing"), *_SHOWN)


@query("grid_search_dt")
def grid_search_dt(spark, sf):
    """The published tree grid of 576 candidates; depth and split limits cost no extra fits."""
    train, _ = _train_test(spark, sf)
    prepared = search.prepare_folds(train, FEATURES, "label", "id")
    return _rounded_cv(search.search_tree(prepared, FEATURES, "label"))


# --- trees in SQL ---------------------------------------------------------------------------


def _each(form: str, by: str = ", ") -> str:
    return by.join(form.format(c=c) for c in range(4))


def _grown_trees(rows: str, shapes: list[trees.Shape], depth: int) -> str:
    """CTEs nodes{d} (tree, node, t0.., f, b) and at{d} (the rows on them) of trees over ``rows`` (part, id, label,
    x1, x2, x3, n, v), level by level down to ``depth``."""
    probs = ", ".join(f"{i}::DOUBLE / {trees.BINS}" for i in range(1, trees.BINS))
    cuts = ", ".join(f"list_sort(list_distinct(quantile_disc({x}, [{probs}]))) AS q{i}" for i, x in enumerate(FEATURES))
    bins = ", ".join(f"len(list_filter(c.q{i}, lambda q: q < r.{x}))" for i, x in enumerate(FEATURES))
    listed = ", ".join(f"({i}, '{s.criterion}', {s.min_leaf}, {s.n_try or 99})" for i, s in enumerate(shapes))

    def side(x: str, n: str) -> str:
        logs = _each("CASE WHEN X{c} > 0 THEN X{c} * ln(X{c}::DOUBLE) ELSE 0::DOUBLE END", " + ").replace("X", x)
        squares = _each("(X{c} * X{c})::DOUBLE", " + ").replace("X", x)
        return f"CASE WHEN criterion = 'gini' THEN ({squares}) / {n} ELSE {logs} - {n} * ln({n}::DOUBLE) END"

    out = [
        f"tcuts AS (SELECT part, {cuts} FROM {rows} WHERE n = 1 GROUP BY part)",
        f"shapes(shape, criterion, min_leaf, n_try) AS (VALUES {listed})",
        f"""at0 AS (SELECT r.part * {len(shapes)} + shape AS tree, 0::BIGINT AS node, id, label, n, v, [{bins}] AS bins
 FROM {rows} r JOIN tcuts c USING (part), shapes)""",
    ]
    for d in range(depth + 1):
        split = "false" if d == depth else f"greatest({_each('t{c}')}) < {_each('t{c}', ' + ')}"
        out.append(f"""hist{d} AS (SELECT tree, node, f, bins[f + 1] AS b, {_each("sum(CASE WHEN label = {c} THEN n ELSE 0 END)::BIGINT AS h{c}")}
 FROM at{d}, range(3) AS fs(f) GROUP BY ALL),
sides{d} AS (SELECT *, {_each("sum(h{c}) OVER upto AS l{c}")}, {_each("sum(h{c}) OVER whole AS t{c}")}, {_each("t{c} - l{c} AS r{c}")} FROM hist{d}
 WINDOW whole AS (PARTITION BY tree, node, f), upto AS (PARTITION BY tree, node, f ORDER BY b ROWS UNBOUNDED PRECEDING)),
scored{d} AS (SELECT d.*, n_try, CASE WHEN nl >= min_leaf AND nr >= min_leaf THEN CASE WHEN criterion = 'gini' THEN gain ELSE round_even(gain, 7) END END AS score
 FROM (SELECT s.*, p.*, {_each("l{c}", " + ")} AS nl, {_each("r{c}", " + ")} AS nr, {side("l", "nl")} + {side("r", "nr")} AS gain
 FROM sides{d} s JOIN shapes p ON p.shape = s.tree % {len(shapes)}) d),
best{d} AS (SELECT tree, node, f, b, score, n_try, {_each("t{c}")} FROM scored{d}
 QUALIFY row_number() OVER (PARTITION BY tree, node, f ORDER BY score DESC NULLS LAST, b) = 1),
drawn{d} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score IS NULL, {duck_hash("feature", "tree", "node", "f")}, f) AS place FROM best{d}),
nodes{d} AS (SELECT tree, node, {d} AS depth, {_each("t{c}")}, CASE WHEN {split} AND score IS NOT NULL THEN f END AS f,
 CASE WHEN {split} AND score IS NOT NULL THEN b END AS b
 FROM drawn{d} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score IS NULL OR place > n_try, score DESC, f) = 1),
at{d + 1} AS (SELECT a.tree, a.node * 2 + 1 + CASE WHEN a.bins[k.f + 1] > k.b THEN 1 ELSE 0 END AS node, id, label, n, v, bins
 FROM at{d} a JOIN nodes{d} k ON a.tree = k.tree AND a.node = k.node WHERE k.f IS NOT NULL)""")
    return ",\n".join(out)


_TREE_ROWS = "trows AS (SELECT 0 AS part, id, label, x1, x2, x3, 1 AS n, 0 AS v FROM train)"
_TREE_LEVELS = " UNION ALL ".join(f"SELECT * FROM nodes{d}" for d in range(4))


@query(
    "tree_nodes",
    duck("imb", then=",\n".join([_TRAIN, _TREE_ROWS, _grown_trees("trows", [trees.Shape(), trees.Shape("entropy", 5)], 3)]))
    + f"""SELECT tree, node, depth, {_each("t{c}::BIGINT AS t{c}")}, f::INTEGER AS feature,
[q0, q1, q2][f + 1][b + 1] AS cut FROM ({_TREE_LEVELS}), tcuts""",
)
def tree_nodes(spark, sf):
    """Every node of two trees of depth 3 with its classes and split."""
    train, _ = _train_test(spark, sf)
    grown = trees.grow(train, FEATURES, "label", 4, [trees.Shape(), trees.Shape("entropy", 5)], max_depth=3)
    at = F.get(F.get(F.array(*[F.array(*map(F.lit, c)) for c in grown.cuts[0]]), F.col("f")), F.col("b"))
    counts = [F.col("t")[c].alias(f"t{c}") for c in range(4)]
    return grown.nodes.select("tree", "node", "depth", *counts, F.col("f").alias("feature"), at.alias("cut"))


_SMALL_GRID = {
    "criterion": ["gini", "entropy"],
    "max_depth": [1, 2, 3],
    "max_features": [None, "sqrt"],
    "min_samples_leaf": [1, 5],
    "min_samples_split": [2, 40],
}
_SMALL = search.candidates(_SMALL_GRID)
_SMALL_SHAPES = list(
    dict.fromkeys(
        trees.Shape(c["criterion"], c["min_samples_leaf"], search.max_features(c["max_features"], 3)) for c in _SMALL
    )
)
_SMALL_ROWS = ", ".join(
    f"({i}, {_SMALL_SHAPES.index(trees.Shape(c['criterion'], c['min_samples_leaf'], search.max_features(c['max_features'], 3)))},"
    f" {c['max_depth']}, {c['min_samples_split']})"
    for i, c in enumerate(_SMALL)
)
_SMALL_SEARCH = ",\n".join(
    [
        _TRAIN,
        _folds("train"),
        _TRAINING,
        _smote("ftrain", "left_out"),
        """trows AS (SELECT left_out AS part, NULL::BIGINT AS id, label, x1, x2, x3, 1 AS n, 0 AS v FROM resampled
 UNION ALL SELECT fold, id, label, x1, x2, x3, 0, 1 FROM folded)""",
        _grown_trees("trows", _SMALL_SHAPES, 3),
        f"cand(candidate_id, shape, max_depth, min_split) AS (VALUES {_SMALL_ROWS})",
        # Where each left-out row stands at each level, and the first of these places at which a candidate stops.
        "passed AS ("
        + " UNION ALL ".join(
            f"SELECT a.tree, a.id, a.label, k.depth, {_each('k.t{c}', ' + ')} AS size, k.f,"
            f" list_position([{_each('k.t{c}')}], greatest({_each('k.t{c}')})) - 1 AS guess"
            f" FROM at{d} a JOIN nodes{d} k ON a.tree = k.tree AND a.node = k.node WHERE a.v = 1"
            for d in range(4)
        )
        + ")",
        f"""cvpred AS (SELECT candidate_id, tree // {len(_SMALL_SHAPES)} AS fold, label AS y, arg_min(guess, depth)::BIGINT AS p
 FROM passed p JOIN cand c ON c.shape = p.tree % {len(_SMALL_SHAPES)}
 WHERE depth = max_depth OR size < min_split OR f IS NULL GROUP BY candidate_id, tree, id, label)""",
        duck_report("cvpred", "y", "p", "candidate_id, fold").strip(),
        "scores AS (SELECT candidate_id, fold, round_even(f1, 12) AS score FROM metrics)",
        duck_cv("scores").strip(),
    ]
)


@query(
    "grid_search_dt_small",
    duck("imb", then=_SMALL_SEARCH)
    + "SELECT candidate_id, "
    + ", ".join(f"round_even(split{f}, 6) AS split{f}" for f in range(5))
    + ", round_even(mean, 6) AS mean, round_even(std, 6) AS std, rank FROM cv",
)
def grid_search_dt_small(spark, sf):
    """A tree search with resampling in each fold: 48 candidates down to depth 3."""
    train, _ = _train_test(spark, sf)
    prepared = search.prepare_folds(train, FEATURES, "label", "id")
    found = search.search_tree(prepared, FEATURES, "label", _SMALL_GRID)
    return _rounded_cv(found.select(*[c for c in found.columns if not c.endswith("_seconds")]))


@query("final_model")
def final_model(spark, sf):
    """Plain naive Bayes against the tuned tree on resampled rows, with remarks."""
    train, test = _train_test(spark, sf)
    return comparison.final_models(train, test, PROBLEM).table


