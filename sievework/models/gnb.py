"""Gaussian naive Bayes as one grouped aggregate (fit) and one projection (predict)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import log, pi
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scalars as S
from sievework.session import collect_few

VAR_SMOOTHING = 1e-9


@dataclass(frozen=True)
class GaussianFit:
    """Class sizes, means and population variances; ``widest`` is the largest overall variance."""

    features: tuple[str, ...]
    classes: tuple[Any, ...]
    counts: tuple[int, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]
    widest: float

    def prior(self, i: int) -> float:
        return self.counts[i] / sum(self.counts)

    def smoothed(self, var_smoothing: float = VAR_SMOOTHING) -> list[list[float]]:
        """Variances plus var_smoothing times the widest feature's variance."""
        extra = var_smoothing * self.widest
        out = [[v + extra for v in row] for row in self.variances]
        if any(v <= 0 for row in out for v in row):
            raise ValueError("all features are constant, no Gaussian can be fitted")
        return out


def fit_parts(
    df: DataFrame, features: Sequence[str], label: str, within: Sequence[str] = ()
) -> dict[tuple, GaussianFit]:
    """One fit per part (for example per left-out fold), all in a single aggregate."""
    features = list(features)
    stats = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        stats += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    rows = collect_few(df.groupBy(*within, label).agg(*stats), f"values of {label!r}")
    parts: dict[tuple, list] = {}
    for r in rows:
        parts.setdefault(tuple(r[w] for w in within), []).append(r)
    fits = {}
    for part, members in parts.items():
        members = sorted(members, key=lambda r: r[label])
        n = sum(r["n"] for r in members)
        widest = 0.0
        for i in range(len(features)):
            mean = sum(r["n"] * r[f"m{i}"] for r in members) / n
            # Spread within the classes plus spread of the class means.
            spread = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in members) / n
            widest = max(widest, spread)
        fits[part] = GaussianFit(
            tuple(features),
            tuple(r[label] for r in members),
            tuple(r["n"] for r in members),
            tuple(tuple(r[f"m{i}"] for i in range(len(features))) for r in members),
            tuple(tuple(r[f"v{i}"] for i in range(len(features))) for r in members),
            widest,
        )
    return fits


def fit(df: DataFrame, features: Sequence[str], label: str) -> GaussianFit:
    return fit_parts(df, features, label)[()]


def fit_table(df: DataFrame, model: GaussianFit, var_smoothing: float = VAR_SMOOTHING) -> DataFrame:
    """(class, feature, n, prior, mean, variance) of a fit as a table."""
    smoothed = model.smoothed(var_smoothing)
    rows = [
        (c, f, model.counts[i], model.prior(i), model.means[i][j], smoothed[i][j])
        for i, c in enumerate(model.classes)
        for j, f in enumerate(model.features)
    ]
    kind = T._infer_type(model.classes[0]).simpleString()
    schema = f"class {kind}, feature string, n long, prior double, mean double, variance double"
    return df.sparkSession.createDataFrame(rows, schema)


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def log_scores(model: GaussianFit, var_smoothing: float = VAR_SMOOTHING) -> list[Column]:
    """Joint log-likelihood per class, in class order."""
    smoothed = model.smoothed(var_smoothing)
    scores = []
    for i in range(len(model.classes)):
        base = log(model.prior(i)) - 0.5 * sum(log(2 * pi * v) for v in smoothed[i])
        gaps = [
            (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m)) / F.lit(v)
            for f, m, v in zip(model.features, model.means[i], smoothed[i])
        ]
        scores.append(F.lit(base) - F.lit(0.5) * _total(gaps))
    return scores


def predict(
    df: DataFrame,
    model: GaussianFit,
    var_smoothing: float = VAR_SMOOTHING,
    prediction: str = "prediction",
    proba: bool = False,
) -> DataFrame:
    """Add the most likely class (lowest on ties) and, on request, ``score_<i>`` probabilities."""
    names = [f"_ll{i}" for i in range(len(model.classes))]
    scored = df.withColumns(dict(zip(names, log_scores(model, var_smoothing))))
    columns = [F.col(n) for n in names]
    scored = scored.withColumn(prediction, S.argmax_first(columns, model.classes))
    if proba:
        top = F.greatest(*columns) if len(columns) > 1 else columns[0]
        grown = [F.exp(c - top) for c in columns]
        scored = scored.withColumns({f"score_{i}": g / _total(grown) for i, g in enumerate(grown)})
    return scored.drop(*names)


def predict_smoothings(
    df: DataFrame, model: GaussianFit, smoothings: Mapping[int, float]
) -> DataFrame:
    """Each row once per smoothing candidate of one fit: ``candidate_id`` and ``prediction``."""
    guesses = F.array(
        *[
            F.struct(
                F.lit(candidate).alias("candidate_id"),
                S.argmax_first(log_scores(model, v), model.classes).alias("prediction"),
            )
            for candidate, v in smoothings.items()
        ]
    )
    return df.select(*df.columns, F.inline(guesses))


def predict_candidates(
    df: DataFrame,
    fits: Mapping[Any, GaussianFit],
    part: str,
    smoothings: Mapping[int, float],
) -> DataFrame:
    """Predictions of every smoothing candidate, each row by the fit of its own ``part``.

    The parameters become one row per (part, candidate): as many as folds x candidates, so they
    are a local table that Spark broadcasts by its size. Adds ``candidate_id`` and ``prediction``. For a single fit score the candidates
    with :func:`predict_smoothings`.
    """
    classes = sorted({c for m in fits.values() for c in m.classes})
    features = next(iter(fits.values())).features
    rows = []
    for p, model in fits.items():
        for candidate, v in smoothings.items():
            smoothed = model.smoothed(v)
            row: list[Any] = [p, candidate]
            for c in classes:
                if c not in model.classes:
                    row += [None] * (1 + 2 * len(features))
                    continue
                i = model.classes.index(c)
                row.append(log(model.prior(i)) - 0.5 * sum(log(2 * pi * x) for x in smoothed[i]))
                row += [*model.means[i], *smoothed[i]]
            rows.append(tuple(row))
    fields = [df.schema[part], T.StructField("candidate_id", T.IntegerType())]
    for i in range(len(classes)):
        fields.append(T.StructField(f"_b{i}", T.DoubleType()))
        fields += [T.StructField(f"_m{i}_{j}", T.DoubleType()) for j in range(len(features))]
        fields += [T.StructField(f"_v{i}_{j}", T.DoubleType()) for j in range(len(features))]
    table = df.sparkSession.createDataFrame(rows, T.StructType(fields))
    scores = []
    for i in range(len(classes)):
        gaps = []
        for j, f in enumerate(features):
            gap = F.col(f) - F.col(f"_m{i}_{j}")
            gaps.append(gap * gap / F.col(f"_v{i}_{j}"))
        scores.append(F.col(f"_b{i}") - F.lit(0.5) * _total(gaps))
    joined = df.join(table, part)
    return joined.select(
        *df.columns, "candidate_id", S.argmax_first(scores, classes).alias("prediction")
    )
