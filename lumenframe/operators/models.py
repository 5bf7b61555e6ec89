"""Fitted models behind one protocol: a prediction and a class as columns of the features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import logistic


@runtime_checkable
class Regression(Protocol):
    def predict(self, features: Column, intercept: float = 0.0) -> Column:
        """The predicted number of a row's features (array<double>)."""


@runtime_checkable
class Classification(Protocol):
    def classify(self, features: Column) -> Column:
        """The class of a row's features."""


@dataclass(frozen=True)
class Linear:
    """x . w; its class is the nearest whole number."""

    weights: Sequence[float]

    def predict(self, features: Column, intercept: float = 0.0) -> Column:
        return logistic.linear(features, self.weights) + intercept

    def classify(self, features: Column) -> Column:
        return logistic.round_class(self.predict(features))


@dataclass(frozen=True)
class Logistic:
    """The probability of class 1; its class is 1 if that is 1 - threshold or more."""

    weights: Sequence[float]
    threshold: float = 0.5

    def predict(self, features: Column, intercept: float = 0.0) -> Column:
        return numeric.logistic(logistic.linear(features, self.weights) + intercept)

    def classify(self, features: Column) -> Column:
        return numeric.classify(self.predict(features), self.threshold)


@dataclass(frozen=True)
class Ensemble:
    """The mean probability of several logistic models; its class is their vote."""

    members: Sequence[Logistic]
    how: str = "majority"

    def _all(self, features: Column, intercept: float) -> list[Column]:
        return [m.predict(features, intercept) for m in self.members]

    def predict(self, features: Column, intercept: float = 0.0) -> Column:
        ps = self._all(features, intercept)
        return sum(ps[1:], ps[0]) / len(ps)

    def classify(self, features: Column) -> Column:
        return logistic.vote(F.array(*self._all(features, 0.0)), self.how)
