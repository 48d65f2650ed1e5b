"""Distances between sequences, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean and deviation of composition distances within and between sources.
INTRA_MEAN, INTRA_SD = 0.0, 0.005189485
INTER_MEAN, INTER_SD = 0.0676654, 0.03419337
INF = float("inf")


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _density(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-(x - mean) * (x - mean) / (2 * sd * sd)) / sd


def composition(d: Column) -> Column:
    """-log10 of the chance that two profiles at Euclidean distance d have one source; infinite where it vanishes."""
    same, other = _density(d, INTRA_MEAN, INTRA_SD), _density(d, INTER_MEAN, INTER_SD)
    ratio = F.try_divide(same, same + other)
    return F.when(ratio > 0, -F.log10(ratio)).otherwise(F.when(d.isNull(), None).otherwise(F.lit(INF)))


def log_factorial(k: Column) -> Column:
    """ln k!, from a table below 16 and by Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = (k + 1).cast("double")
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(k < 16, F.get(small, k.cast("int"))).otherwise(series)


def coverage(k: Column, mu: Column) -> Column:
    """-log10 of the Poisson mass of int(k) under int(mu); infinite where it underflows."""
    k, mu = k.cast("int"), mu.cast("int")
    log_mass = k * F.ln(F.greatest(mu, F.lit(1)).cast("double")) - log_factorial(k) - mu
    mass = F.exp(log_mass)
    apart = F.when(mass > 0, -F.log10(mass)).otherwise(F.lit(INF))
    return F.when(k.isNull() | mu.isNull(), None).when(mu <= 0, F.when(k == mu, F.lit(0.0)).otherwise(F.lit(INF))).otherwise(apart)


def total(topological: Column, comp: Column, cov: Column) -> Column:
    return topological + F.coalesce(comp, F.lit(0.0)) + cov
