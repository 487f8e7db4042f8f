"""Tail probabilities for a handful of test statistics, from the math library Spark ships."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def _dist(spark: SparkSession, name: str, *args: float):
    package = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    return getattr(package, name)(*[float(a) for a in args])


def t_two_sided(spark: SparkSession, statistic: float, dof: float) -> float:
    if math.isinf(statistic):
        return 0.0
    return 2.0 * _dist(spark, "TDistribution", dof).cumulativeProbability(-abs(statistic))


def chi_square_upper(spark: SparkSession, statistic: float, dof: int) -> float:
    """Upper tail by the regularised gamma function, exact far into the tail."""
    if dof < 1:
        return 1.0
    gamma = spark.sparkContext._jvm.org.apache.commons.math3.special.Gamma
    return float(gamma.regularizedGammaQ(dof / 2.0, max(statistic, 0.0) / 2.0))


def f_upper(spark: SparkSession, statistic: float, dof1: int, dof2: int) -> float:
    beta = spark.sparkContext._jvm.org.apache.commons.math3.special.Beta
    return float(beta.regularizedBeta(dof2 / (dof2 + dof1 * statistic), dof2 / 2.0, dof1 / 2.0))


def normal_two_sided(statistic: float) -> float:
    return math.erfc(abs(statistic) / math.sqrt(2.0))


def pearson_p(spark: SparkSession, r: float, n: int) -> float:
    """Two-tailed p-value of a correlation coefficient."""
    if n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(spark, r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
