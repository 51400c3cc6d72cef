"""The eight classifiers under one interface, with the parameters they are compared with."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.models import boosting, gnb, knn, mllib


class Predictor(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Problem:
    """What every model needs to know about a table. Classes are 0..n_classes-1."""

    features: tuple[str, ...]
    label: str
    key: str
    n_classes: int

    @property
    def classes(self) -> list[int]:
        return list(range(self.n_classes))


@dataclass(frozen=True)
class ModelSpec:
    """A fresh ``fit`` is made per run, so nothing carries over between scenarios."""

    name: str
    fit: Callable[[DataFrame, Problem], Predictor]
    use_scaling: bool = False


@dataclass(frozen=True)
class _Gaussian:
    model: gnb.GaussianFit
    problem: Problem
    var_smoothing: float

    def predict(self, df: DataFrame) -> DataFrame:
        out = gnb.predict(df, self.model, self.var_smoothing, proba=True)
        # Scores by class number, also when the training rows lack a class.
        found = {c: f"score_{i}" for i, c in enumerate(self.model.classes)}
        scores = [
            (F.col(found[c]) if c in found else F.lit(0.0)).alias(f"score_{c}")
            for c in self.problem.classes
        ]
        return out.select(*df.columns, "prediction", *scores)


@dataclass(frozen=True)
class _Nearest:
    train: DataFrame
    problem: Problem
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        p = self.problem
        return knn.classify(self.train, df, p.features, p.label, p.key, p.classes, self.k, proba=True)


def gaussian_spec(var_smoothing: float = gnb.VAR_SMOOTHING) -> ModelSpec:
    def fit(train: DataFrame, p: Problem) -> Predictor:
        return _Gaussian(gnb.fit(train, p.features, p.label), p, var_smoothing)

    return ModelSpec("Naive Bayes", fit)


def nearest_spec(k: int = 5) -> ModelSpec:
    def fit(train: DataFrame, p: Problem) -> Predictor:
        return _Nearest(train, p, k)

    return ModelSpec("KNN", fit, use_scaling=True)


def _plain_spec(name: str, fit_model: Callable[..., Predictor], use_scaling: bool = False, **options: Any):
    def fit(train: DataFrame, p: Problem) -> Predictor:
        return fit_model(train, p.features, p.label, p.n_classes, **options)

    return ModelSpec(name, fit, use_scaling)


def tree_spec(name: str = "Decision Tree", **options: Any) -> ModelSpec:
    return _plain_spec(name, mllib.fit_decision_tree, **options)


def boosted_spec(name: str, how: boosting.Settings) -> ModelSpec:
    return _plain_spec(name, boosting.fit_boosted, how=how)


def default_registry(trees: int = 100, rounds: int = 100) -> Sequence[ModelSpec]:
    return [
        _plain_spec("Logistic Regression", mllib.fit_logistic_ovr, use_scaling=True),
        gaussian_spec(),
        tree_spec(),
        _plain_spec("Random Forest", mllib.fit_random_forest, trees=trees),
        _plain_spec("SVM (Fourier features)", mllib.fit_svm_rff, use_scaling=True),
        nearest_spec(),
        boosted_spec("Gradient Boosting", boosting.Settings(rounds=rounds)),
        boosted_spec("Boosted Trees Preset", replace(boosting.PRESET, rounds=rounds)),
    ]
