"""Closed-form statistics as Column expressions: intervals, quantiles, sample sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % normal quantile of the published intervals.
Z95 = 1.959963985
#: Quantiles used exactly where a table gives them.
QUANTILES = {0.80: 0.8416212336, 0.90: 1.2815515655, 0.95: 1.6448536270, 0.975: 1.9599639845}
#: Coefficients of Acklam's rational approximation of the normal quantile.
ACKLAM_CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
ACKLAM_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the score interval, within 0..1; null where n is 0."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    bounded = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return bounded(mid - half), bounded(mid + half)


def newcombe(k1: Column, n1: Column, k0: Column, n0: Column) -> tuple[Column, Column, Column]:
    """Difference of two proportions and its hybrid score interval."""
    p1, p0 = k1 / n1, k0 / n0
    (l1, u1), (l0, u0) = wilson(k1, n1), wilson(k0, n0)
    return p1 - p0, p1 - p0 - F.sqrt((p1 - l1) ** 2 + (u0 - p0) ** 2), p1 - p0 + F.sqrt((u1 - p1) ** 2 + (p0 - l0) ** 2)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal: exact table values, else Acklam's approximation."""
    (a, b), (c, d) = ACKLAM_CENTRE, ACKLAM_TAIL
    tail = lambda q: _poly(c, q) / _poly(d, q)
    r = (p - 0.5) * (p - 0.5)
    out = F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise((p - 0.5) * _poly(a, r) / _poly(b, r))
    for k, v in QUANTILES.items():
        out = F.when(p == k, F.lit(v)).otherwise(out)
    return out


def design_effect(m: Column, rho: Column) -> Column:
    return 1 + (m - 1) * rho


def n_per_arm(p0: Column, p1: Column, alpha: Column, power: Column) -> Column:
    """Observations per arm to detect p1 against p0, without clustering."""
    bar = (p0 + p1) / 2
    za, zb = normal_quantile(1 - alpha / 2), normal_quantile(power)
    top = za * F.sqrt(2 * bar * (1 - bar)) + zb * F.sqrt(p0 * (1 - p0) + p1 * (1 - p1))
    return top * top / ((p1 - p0) * (p1 - p0))


def log_factorials(n: int) -> list[float]:
    """ln(0!) .. ln(n!), by summing logarithms."""
    out = [0.0]
    for i in range(1, n + 1):
        out.append(out[-1] + math.log(i))
    return out


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no likelier than the given one, with slack 1e-9, by log-gamma terms."""
    r1, r2, c1 = a + b, c + d, a + c
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    at = lambda x: choose(r1, x) + choose(r2, c1 - x) - choose(r1 + r2, c1)
    seen = at(a) + math.log1p(1e-9)
    return min(1.0, math.fsum(math.exp(p) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (p := at(x)) <= seen))


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact p of b against c discordant pairs."""
    n = b + c
    if not n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(min(b, c) + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, terms)))


def fisher_column(a: Column, b: Column, c: Column, d: Column, logs: Column) -> Column:
    """The same p as fisher_exact as an expression; logs: array of log-factorials up to the total of the table."""
    r1, r2, c1 = a + b, c + d, a + c
    choose = lambda n, k: F.get(logs, n.cast("int")) - F.get(logs, k.cast("int")) - F.get(logs, (n - k).cast("int"))
    at = lambda x: choose(r1, x) + choose(r2, c1 - x) - choose(r1 + r2, c1)
    xs = F.sequence(F.greatest(F.lit(0).cast("long"), c1 - r2), F.least(r1, c1))
    return F.least(F.lit(1.0), F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.when(at(x) <= at(a) + math.log1p(1e-9), F.exp(at(x))).otherwise(0.0)))


def clusters_per_arm(p0: Column, p1: Column, m: Column, rho: Column, alpha: Column, power: Column) -> Column:
    """Clusters of m observations per arm to detect p1 against p0."""
    return F.ceil(n_per_arm(p0, p1, alpha, power) * design_effect(m, rho) / m).cast("long")


def detectable_rate(p0: Column, clusters: Column, m: Column, rho: Column, alpha: Column, power: Column, steps: int = 200) -> Column:
    """Least rate above p0 that so many clusters an arm detect, by bisection between p0 + 1e-5 and 0.999; 0.999 where not
    even that is detected."""
    start = F.struct((p0 + 1e-5).alias("low"), F.lit(0.999).alias("high"))

    def step(a: Column, _: Column) -> Column:
        mid = (a["low"] + a["high"]) / 2
        short = clusters_per_arm(p0, mid, m, rho, alpha, power) > clusters
        return F.struct(F.when(short, mid).otherwise(a["low"]).alias("low"), F.when(short, a["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["high"])
