"""Curves and fit measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(t: Column, top: Column, k: Column, t0: Column) -> Column:
    return top / (1 + F.exp(-k * (t - t0)))


def doubling_time(k: Column) -> Column:
    """Infinite where nothing grows."""
    return F.when(k > 0, math.log(2) / k).otherwise(float("inf"))


def bass(t: Column, m: Column, p: Column, q: Column) -> Column:
    e = F.exp(-(p + q) * t)
    return m * (p + q) * (p + q) / p * e / ((1 + q / p * e) * (1 + q / p * e))


def bass_peak(p: Column, q: Column) -> Column:
    return F.when(q > p, F.log(q / p) / (p + q)).otherwise(0.0)


def aicc(loglik: Column, k: int, n: Column) -> Column:
    """Infinite with too few rows."""
    return F.when(n - k - 1 > 0, -2 * loglik + 2 * k + 2 * k * (k + 1) / (n - k - 1)).otherwise(float("inf"))


def r_squared(y: Column, fitted: Column) -> Column:
    """An aggregate; 0 where y doesn't vary."""
    left, total = F.sum((y - fitted) * (y - fitted)), F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - left / total).otherwise(0.0)
