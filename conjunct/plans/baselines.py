"""Baseline models: ridge, lasso and elastic net by MLlib with the textbook objectives, Poisson ridge by Newton steps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.plans.solver import poisson_glm


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def _linear(df: DataFrame, features: list[str], penalty: float, l1_ratio: float):
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=penalty, elasticNetParam=l1_ratio, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=2000)
    return model.fit(assembled(df, features))


def lasso(df: DataFrame, features: list[str], alpha: float):
    """1 / (2 n) |y - Xw|^2 + alpha |w|_1, features taken as they are."""
    return _linear(df, features, alpha, 1.0)


def ridge(df: DataFrame, features: list[str], alpha: float):
    """|y - Xw|^2 + alpha |w|^2; MLlib scales its penalty by the label's spread and the number of rows."""
    return _linear(df, features, alpha * _spread(df) / df.count(), 0.0)


def _spread(df: DataFrame) -> float:
    return float(df.agg(F.stddev_samp("y")).first()[0] or 1.0)


def forest(df: DataFrame, features: list[str], trees: int = 300, depth: int = 10, seed: int = 42):
    return RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, features))


def grid_search(x: np.ndarray, y: np.ndarray, folds: np.ndarray, alphas: list[float]) -> tuple[float, list[float]]:
    """Poisson ridge: the alpha of least mean fold rmse (the first of equal ones), and the means."""
    means = []
    for a in alphas:
        errors = []
        for f in np.unique(folds):
            b, w = poisson_glm(x[folds != f], y[folds != f], a)
            errors.append(math.sqrt(((np.exp(b + x[folds == f] @ w) - y[folds == f]) ** 2).mean()))
        means.append(float(np.mean(errors)))
    return alphas[int(np.argmin(means))], means
