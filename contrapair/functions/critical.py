"""Critical values of Student's t as a table and a series, and the plain functions they come from.

Column expressions of the tails are in ``tails``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z99 = 2.3263478740408408
Z995 = 2.5758293035489004


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Gauss-Legendre quadrature of the substituted integral."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    nodes, weights = _legendre()
    # t = x * u^2 removes the half-power singularity at 0
    u = 0.5 * (nodes + 1.0)
    log_f = (a - 1) * np.log(x * u * u) + (b - 1) * np.log1p(-x * u * u) + np.log(2 * x * u)
    log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return float(min(1.0, np.sum(0.5 * weights * np.exp(log_f - log_b))))


@lru_cache(maxsize=1)
def _legendre():
    return np.polynomial.legendre.leggauss(400)


def t_sf(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_quantile(p: float, df: float) -> float:
    if not (0 < p < 1 and df > 0):
        return float("nan")
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1 - p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_sf(mid, df) > 1 - p else (lo, mid)
    return 0.5 * (lo + hi)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    if not (math.isfinite(f) and d1 > 0 and d2 > 0):
        return float("nan")
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * max(f, 0.0)))


TABLE_DF = 60


@lru_cache(maxsize=None)
def t_table(p: float) -> dict[int, float]:
    return {d: round(t_quantile(p, d), 10) for d in range(1, TABLE_DF + 1)}


def _t_series(z: float) -> list[float]:
    """Coefficients of 1/df^i in the large-df expansion of the t quantile."""
    return [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_crit(df: Column, p: float) -> Column:
    """Quantile for a whole-number df: a literal map to 60, the expansion beyond; null below 1."""
    table = F.create_map(*[F.lit(x) for pair in t_table(p).items() for x in pair])
    v = F.greatest(df.cast("double"), F.lit(1.0))
    series = F.lit(0.0)
    for i, c in enumerate(_t_series(normal_quantile(p))):
        series = series + F.lit(c) / F.pow(v, F.lit(float(i)))
    return F.when(df < 1, F.lit(None)).when(df <= TABLE_DF, F.try_element_at(table, df.cast("int"))).otherwise(series)


def t_crit_sql(df: str, p: float) -> str:
    rows = " ".join(f"WHEN {d} THEN {v!r}::DOUBLE" for d, v in t_table(p).items())
    series = " + ".join(f"({c!r}::DOUBLE) / pow({df}, {i})" for i, c in enumerate(_t_series(normal_quantile(p))))
    return f"(CASE WHEN ({df}) < 1 THEN NULL WHEN ({df}) <= {TABLE_DF} THEN (CASE ({df}) {rows} END) ELSE {series} END)"


def t995(df: Column) -> Column:
    return t_crit(df, 0.995)


def t995_sql(df: str) -> str:
    return t_crit_sql(df, 0.995)
