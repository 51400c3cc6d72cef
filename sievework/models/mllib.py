"""Classifiers fitted by Spark MLlib, with the reference settings of each algorithm.

Labels are 0..C-1. Every ``fit_*`` returns a model with ``predict(df)`` that adds ``prediction``
and one ``score_<class>`` column per class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.portable import SEED
from sievework.models import forest as cell_forest
from sievework.operators import profile
from sievework.session import materialize

# MLlib's deepest tree; stands in for "no limit".
MAX_DEPTH = 30
# Candidate cuts per feature. Statistics per tree level are nodes x features x bins x classes.
MAX_BINS = 128

# Keep each row's node instead of walking it down from the root at every level: deep trees need it.
DEEP = True
# Classes fitted side by side by one-vs-rest; each fit is a series of short jobs.
PARALLEL_FITS = 8
# Rows from which a fit fills the executors on its own: classes one after the other, for MLlib keeps the rows of each
# in memory, and forests by cells of rows, for MLlib keeps all trees on the driver and reads the rows for each group of nodes.
MANY_ROWS = 100_000
# Blocks that such a fit keeps its rows in: below half a region of the collector's, for larger ones take two regions each.
BLOCK_MB = 0.25
# Bytes of vectors in a task of its passes at most about, where the executors' cores are fewer.
PART_BYTES = 1 << 28

_VECTOR = "_features"
_LABEL = "_label"


@dataclass(frozen=True)
class FittedModel:
    """A fitted MLlib pipeline and how its raw output becomes class scores."""

    model: Model
    n_classes: int
    scores: str  # probability | sigmoid | margin

    def predict(self, df: DataFrame) -> DataFrame:
        raw = "probability" if self.scores == "probability" else "rawPrediction"
        out = self.model.transform(df)
        values = vector_to_array(raw)
        columns = [values[i] for i in range(self.n_classes)]
        if self.scores == "sigmoid":
            # One-vs-rest margins to probabilities that add up to one.
            odds = [F.lit(1.0) / (F.lit(1.0) + F.exp(-c)) for c in columns]
            total = sum(odds[1:], odds[0])
            columns = [F.try_divide(o, total) for o in odds]
        scored = out.withColumns({f"score_{i}": c for i, c in enumerate(columns)})
        return scored.select(*df.columns, "prediction", *[f"score_{i}" for i in range(self.n_classes)])


def _fit(estimator, train: DataFrame, features: Sequence[str], label: str, n_classes: int, scores: str):
    assembler = VectorAssembler(inputCols=list(features), outputCol=_VECTOR, handleInvalid="error")
    estimator = estimator.setFeaturesCol(_VECTOR).setLabelCol(_LABEL)
    rows = train.select(*features, F.col(label).cast("double").alias(_LABEL))
    return FittedModel(Pipeline(stages=[assembler, estimator]).fit(rows), n_classes, scores)


def _fit_in_turn(ovr: OneVsRest, train: DataFrame, features: Sequence[str], label: str, n_classes: int, scores: str):
    """``_fit`` of one class after the other, on the same vectors and with the same settings.

    ``OneVsRest`` keeps the vectors of all rows, and each of its fits a second time, in the executors' memory. Here
    they are written once and read by each class, and only the blocks of the class at hand are kept.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol=_VECTOR, handleInvalid="error")
    made = assembler.transform(train.select(*features, F.col(label).cast("double").alias(_LABEL)))
    rows = materialize(made.select(_LABEL, _VECTOR), "vectors")
    # A fit is hundreds of short passes, whose time is that of starting their tasks if these are many.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(rows.count() * len(features) * 8 / PART_BYTES))
    rows = rows.coalesce(parts)
    inner = ovr.getClassifier().copy().setMaxBlockSizeInMB(BLOCK_MB).setFeaturesCol(_VECTOR).setLabelCol("_is_class")
    models = []
    for c in range(int(rows.agg(F.max(_LABEL)).first()[0]) + 1):
        is_class = (F.col(_LABEL) == F.lit(float(c))).cast("double").alias("_is_class")
        models.append(inner.fit(rows.select(_VECTOR, is_class)))
    model = ovr.setFeaturesCol(_VECTOR).setLabelCol(_LABEL)._copyValues(OneVsRestModel(models=models))
    return FittedModel(PipelineModel([assembler, model]), n_classes, scores)


def fit_decision_tree(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    n_classes: int,
    criterion: str = "gini",
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    max_features: int | None = None,
) -> FittedModel:
    """One tree. ``max_features`` (a number of features per split) needs a one-tree forest."""
    depth = MAX_DEPTH if max_depth is None else min(max_depth, MAX_DEPTH)
    shared = dict(
        impurity=criterion,
        maxDepth=depth,
        maxBins=MAX_BINS,
        minInstancesPerNode=min_samples_leaf,
        seed=SEED,
        cacheNodeIds=DEEP,
    )
    if max_features is None:
        tree = DecisionTreeClassifier(**shared)
    else:
        tree = RandomForestClassifier(
            numTrees=1, bootstrap=False, featureSubsetStrategy=str(max_features), **shared
        )
    return _fit(tree, train, features, label, n_classes, "probability")


def fit_random_forest(
    train: DataFrame, features: Sequence[str], label: str, n_classes: int, trees: int = 100
) -> FittedModel | cell_forest.Forest:
    if _row_count(train) > MANY_ROWS:
        found = cell_forest.fit_forest(train, features, label, n_classes, trees)
        if found is not None:
            return found
    forest = RandomForestClassifier(
        numTrees=trees,
        featureSubsetStrategy="sqrt",
        maxDepth=MAX_DEPTH,
        maxBins=MAX_BINS,
        seed=SEED,
        cacheNodeIds=DEEP,
    )
    return _fit(forest, train, features, label, n_classes, "probability")


def _row_count(train: DataFrame) -> int:
    return max(1, train.count())


def fit_logistic_ovr(
    train: DataFrame, features: Sequence[str], label: str, n_classes: int, c: float = 1.0
) -> FittedModel:
    """One-vs-rest logistic regression; the penalty per row is 1 / (n * C). Expects scaled features."""
    inner = LogisticRegression(
        maxIter=1000, regParam=1.0 / (_row_count(train) * c), elasticNetParam=0.0, standardization=False
    )
    ovr = OneVsRest(classifier=inner, rawPredictionCol="rawPrediction", parallelism=PARALLEL_FITS)
    return _fit(ovr, train, features, label, n_classes, "sigmoid")


# --- radial-kernel SVM through random Fourier features -------------------------------------

FOURIER_FEATURES = 64


def kernel_width(train: DataFrame, features: Sequence[str]) -> float:
    """gamma = 1 / (d * variance of all feature cells)."""
    rows = profile.moments(train, features).collect()
    mean = sum(r["mean"] for r in rows) / len(rows)
    second = sum(r["std_pop"] ** 2 + r["mean"] ** 2 for r in rows) / len(rows)
    variance = second - mean * mean
    return 1.0 / (len(rows) * variance) if variance > 0 else 1.0


@dataclass(frozen=True)
class FourierMap:
    """cos(w.x + b) features whose dot product approaches exp(-gamma |x - y|^2)."""

    features: tuple[str, ...]
    weights: np.ndarray
    phases: np.ndarray

    def names(self) -> list[str]:
        return [f"_rff{i}" for i in range(len(self.phases))]

    def apply(self, df: DataFrame) -> DataFrame:
        scale = float(np.sqrt(2.0 / len(self.phases)))
        columns = {}
        for i, name in enumerate(self.names()):
            angle = F.lit(float(self.phases[i]))
            for j, f in enumerate(self.features):
                angle = angle + F.lit(float(self.weights[i, j])) * F.col(f)
            columns[name] = F.lit(scale) * F.cos(angle)
        return df.withColumns(columns)


def fourier_map(features: Sequence[str], gamma: float, n: int = FOURIER_FEATURES, seed: int = SEED) -> FourierMap:
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n, len(features)))
    phases = rng.uniform(0.0, 2.0 * np.pi, size=n)
    return FourierMap(tuple(features), weights, phases)


@dataclass(frozen=True)
class FourierSvm:
    mapping: FourierMap
    linear: FittedModel

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.linear.predict(self.mapping.apply(df))
        return out.drop(*self.mapping.names())


def fit_svm_rff(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    n_classes: int,
    c: float = 1.0,
    n_fourier: int = FOURIER_FEATURES,
) -> FourierSvm:
    """Approximate radial-kernel SVM, one-vs-rest. Expects scaled features."""
    mapping = fourier_map(features, kernel_width(train, features), n_fourier)
    rows = _row_count(train)
    inner = LinearSVC(regParam=1.0 / (rows * c), maxIter=100, standardization=False)
    ovr = OneVsRest(classifier=inner, rawPredictionCol="rawPrediction", parallelism=PARALLEL_FITS)
    fit = _fit if rows <= MANY_ROWS else _fit_in_turn
    linear = fit(ovr, mapping.apply(train), mapping.names(), label, n_classes, "margin")
    return FourierSvm(mapping, linear)
