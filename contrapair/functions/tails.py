"""Tails and quantiles of the normal, Student t and F distributions as column expressions.

The incomplete beta function is one Gauss-Legendre sum over fixed nodes, and a quantile is a Newton iteration folded over a
short sequence, so everything stays inside one projection: no Python worker, no loop over rows. The SQL forms take the same
nodes from columns ``us`` and ``ws`` of the view ``v_nodes``, but the engine's own log-gamma.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from contrapair.functions.vectors import let, total

NODES = 160
NEWTON = 60
_X, _W = np.polynomial.legendre.leggauss(NODES)
#: Nodes and weights on the unit interval.
US, WS = [float(x) for x in 0.5 * (_X + 1)], [float(w) for w in 0.5 * _W]
NODES_SQL = f"SELECT {US!r}::DOUBLE[] AS us, {WS!r}::DOUBLE[] AS ws"

#: Lanczos' series for the gamma function with g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a number of one half or more."""
    def at(z: Column) -> Column:
        series = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:]):
            series = series + F.lit(c) / (z + i)
        t = z + 6.5
        return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.log(t) - t + F.log(series)

    return let(x.cast("double"), at)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, a and b at least one half; 0 below 0 and 1 above 1."""
    def body(s: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        log_b = log_gamma(p) + log_gamma(q) - log_gamma(p + q)

        tail = let(F.struct(p.alias("p"), q.alias("q"), z.alias("z"), log_b.alias("log_b")),
                   lambda r: total(F.zip_with(F.lit(US), F.lit(WS), lambda u, w: w * F.exp(
                       (r["p"] - 1) * F.log(r["z"] * u * u) + (r["q"] - 1) * F.log1p(-r["z"] * u * u) + F.log(2 * r["z"] * u) - r["log_b"]))))
        whole = F.when(z <= 0, F.lit(0.0)).otherwise(F.least(tail, F.lit(1.0)))
        return F.when(s["flip"], 1 - whole).otherwise(whole)

    a, b, x = a.cast("double"), b.cast("double"), F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(0.0))
    flip = x > (a + 1) / (a + b + 2)
    return let(F.struct(F.when(flip, b).otherwise(a).alias("p"), F.when(flip, a).otherwise(b).alias("q"),
                        F.when(flip, 1 - x).otherwise(x).alias("z"), flip.alias("flip")), body)


def t_sf(t: Column, df: Column) -> Column:
    """Upper tail of Student's t; null without degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    half = beta_inc(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(df >= 1, F.when(t >= 0, half).otherwise(1 - half))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F ratio; null without degrees of freedom."""
    f = F.greatest(f.cast("double"), F.lit(0.0))
    return F.when((d1 >= 1) & (d2 >= 1), beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def _newton(alpha: Column, tail, density) -> Column:
    """The point with this upper tail, at most one half: the tail is convex there, so steps from 0 rise to it and never pass it."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(0.0), lambda q, i: q + F.greatest((tail(q) - alpha) / density(q), F.lit(0.0)))


def t_quantile(p: Column, df: Column) -> Column:
    """Quantile of Student's t for 0 < p < 1 and df of one or more, else null."""
    def body(s: Column) -> Column:
        d = s["d"]
        log_c = log_gamma((d + 1) / 2) - log_gamma(d / 2) - F.log(d * math.pi) / 2
        q = let(F.struct(d.alias("d"), s["a"].alias("a"), log_c.alias("c")), lambda r: _newton(
            r["a"], lambda x: t_sf(x, r["d"]), lambda x: F.exp(r["c"] - (r["d"] + 1) / 2 * F.log1p(x * x / r["d"]))))
        return F.when(s["p"] < 0.5, -q).otherwise(q)

    p, df = p.cast("double"), df.cast("double")
    ok = (p > 0) & (p < 1) & (df >= 1)
    return F.when(ok, let(F.struct(p.alias("p"), F.least(p, 1 - p).alias("a"), df.alias("d")), body))


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-15."""
    z = F.greatest(F.least(z.cast("double"), F.lit(9.0)), F.lit(-9.0))
    return F.lit(0.5) - let(z, lambda x: x / math.sqrt(2 * math.pi) * total(F.zip_with(F.lit(US), F.lit(WS), lambda u, w: w * F.exp(-x * x * u * u / 2))))


def normal_cdf(z: Column) -> Column:
    return 1 - normal_sf(z)


def normal_quantile(p: Column) -> Column:
    """Quantile of the normal distribution; null outside 0 < p < 1."""
    def body(x: Column) -> Column:
        q = _newton(F.least(x, 1 - x), normal_sf, lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        return F.when(x < 0.5, -q).otherwise(q)

    p = p.cast("double")
    return F.when((p > 0) & (p < 1), let(p, body))


# ---- the same in SQL; ``us`` and ``ws`` must be columns in scope ----------------------------------------------------


def _beta_core_sql(p: str, q: str, z: str) -> str:
    logs = f"lgamma({p}) + lgamma({q}) - lgamma({p} + {q})"
    z = f"greatest({z}, 1e-300::DOUBLE)"  # the other branches of a CASE are worked out too
    term = f"ws[i] * exp(({p} - 1) * ln({z} * us[i] * us[i]) + ({q} - 1) * ln(greatest(1 - {z} * us[i] * us[i], 1e-300::DOUBLE)) + ln(2 * {z} * us[i]) - ({logs}))"
    return f"least(list_sum(list_transform(range(1, {NODES + 1}), lambda i: {term})), 1.0::DOUBLE)"


def beta_inc_sql(a: str, b: str, x: str) -> str:
    a, b, x = f"({a})::DOUBLE", f"({b})::DOUBLE", f"({x})::DOUBLE"
    return (f"(CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) "
            f"THEN 1 - {_beta_core_sql(b, a, f'(1 - {x})')} ELSE {_beta_core_sql(a, b, x)} END)")


def t_sf_sql(t: str, df: str) -> str:
    half = f"{beta_inc_sql(f'({df}) / 2', '0.5', f'({df}) / (({df}) + ({t}) * ({t}))')} / 2"
    return f"(CASE WHEN ({t}) >= 0 THEN {half} ELSE 1 - {half} END)"


def f_sf_sql(f: str, d1: str, d2: str) -> str:
    return beta_inc_sql(f"({d2}) / 2", f"({d1}) / 2", f"({d2}) / (({d2}) + ({d1}) * greatest({f}, 0))")


def _newton_sql(alpha: str, tail: str, density: str) -> str:
    """tail and density are written in q."""
    return f"list_reduce(list_concat([0.0::DOUBLE], list_transform(range({NEWTON}), lambda n: 0.0::DOUBLE)), lambda q, n: q + greatest(({tail} - ({alpha})) / ({density}), 0))"


def t_quantile_sql(p: str, df: str) -> str:
    """For p of one half or more."""
    density = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2) - ln(({df}) * pi()) / 2 - (({df}) + 1) / 2 * ln(1 + q * q / ({df})))"
    return _newton_sql(f"1 - ({p})", t_sf_sql("q", df), density)


def normal_cdf_sql(z: str) -> str:
    z = f"greatest(least({z}, 9.0::DOUBLE), -9.0::DOUBLE)"
    return f"(0.5::DOUBLE + {z} / sqrt(2 * pi()) * list_sum(list_transform(range(1, {NODES + 1}), lambda i: ws[i] * exp(-({z}) * ({z}) * us[i] * us[i] / 2))))"


def normal_quantile_sql(p: str) -> str:
    q = _newton_sql(f"least({p}, 1 - ({p}))", f"(1 - {normal_cdf_sql('q')})", "exp(-q * q / 2) / sqrt(2 * pi())")
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.5 THEN -{q} ELSE {q} END)"
