"""Resampling, exact tests and models over incident frames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.functions import stats
from mentionlab.operators import permutation

SEED = 20260101
#: Poisson(1) probabilities summed: weights of a bootstrap replicate by the digest's uniform number.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]


#: Tests of one family at most.
MAX_TESTS = 10_000
#: Rows that resampling by digests may deal; a large frame is resampled from its strata.
MAX_DEALT, MAX_INCIDENTS = 50_000_000, 200_000
#: Replicates that are drawn at once, times strata.
SLICE = 4_000_000


def _small(incidents: int, times: int) -> None:
    if incidents > MAX_INCIDENTS or incidents * times > MAX_DEALT:
        raise ValueError(f"{incidents} incidents times {times} are too many to deal: resample from strata")


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("incident_id").cast("string")))


def permutation_by_hash(incidents: DataFrame, times: int, seed: int = SEED) -> DataFrame:
    """Cluster permutation test: exposure is dealt anew over incidents, the statistic is the pooled difference; two-sided,
    add-one. The order of digests is the permutation, so reruns agree. Rows are incidents x times, and a replicate's
    incidents are in one task: a frame beyond MAX_DEALT is refused; permutation_by_strata has the same distribution."""
    told = incidents.agg(F.count_if(F.col("exposed") == 1), F.count(F.lit(1))).first()
    _small(told[1], times)
    m = told[0]
    dealt = incidents.select("incident_id", "k", "n", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(_digest(seed), "incident_id")))
    rate = lambda on: F.sum(F.when(on, F.col("k"))) / F.sum(F.when(on, F.col("n")))
    diffs = placed.groupBy("rep").agg((rate(F.col("place") <= m) - rate(F.col("place") > m)).alias("diff"))
    seen = incidents.agg((rate(F.col("exposed") == 1) - rate(F.col("exposed") == 0)).alias("observed")).first()[0]
    extreme = F.count_if(F.abs("diff") >= abs(seen) - 1e-12) if seen is not None else F.lit(0).cast("long")
    return diffs.agg(F.count(F.lit(1)).alias("permutations"), extreme.alias("as_extreme")).select("permutations", "as_extreme", ((1 + F.col("as_extreme")) / (1 + F.col("permutations"))).alias("p"), F.lit(seen).cast("double").alias("observed"))


def permutation_by_strata(incidents: DataFrame, times: int = 20_000, seed: int = SEED, exact_up_to: int = permutation.EXACT_STATES) -> dict:
    """The same test from (k, n) strata, in bounded memory for any number of incidents: see permutation.permutation_frames."""
    r = permutation.permutation_frames(incidents.withColumn("frame", F.lit("all")), "frame", times, seed, exact_up_to).first()
    return {"p": r.p, "exact": r.exact, "observed": r.observed} if r else {"p": None, "exact": None, "observed": None}


def _slices(times: int, width: int):
    """times in parts, so that a part of that width stays bounded."""
    step = max(1, SLICE // max(1, width))
    for at in range(0, times, step):
        yield min(step, times - at)


def bootstrap_by_strata(incidents: DataFrame, times: int = 1000, seed: int = SEED) -> dict:
    """Percentile intervals over incidents drawn with replacement, from (k, n, exposed) strata: drawing incidents is drawing
    how often each stratum comes, a multinomial vector. low and high of the odds ratio, as the model without covariates
    has it on each replicate, and of the rate difference. A replicate with an empty arm, and for the odds ratio one with
    an empty cell, fails; where half of them fail there is no interval."""
    s = [tuple(r) for r in incidents.groupBy("k", "n", "exposed").agg(F.count(F.lit(1))).orderBy("k", "n", "exposed").collect()]
    k, n, x, size = (np.array(c, np.float64) for c in zip(*s)) if s else (np.zeros(0),) * 4
    odds, diffs = [], []
    rng = np.random.default_rng(seed)
    for some in _slices(times, len(s)) if s else ():
        w = rng.multinomial(int(size.sum()), size / size.sum(), size=some)
        k1, n1, k0, n0 = w @ (k * x), w @ (n * x), w @ (k * (1 - x)), w @ (n * (1 - x))
        with np.errstate(all="ignore"):
            o, d = (k1 * (n0 - k0)) / (k0 * (n1 - k1)), k1 / n1 - k0 / n0
        odds.append(o[np.isfinite(o) & (o > 0)])
        diffs.append(d[np.isfinite(d)])
    out = {"replicates": times}
    for name, found in (("odds", odds), ("diff", diffs)):
        got = np.concatenate(found) if found else np.zeros(0)
        enough = len(got) >= times * 0.5 and len(got) > 0
        out |= {f"{name}_failed": times - len(got), f"{name}_low": float(np.percentile(got, 2.5)) if enough else None, f"{name}_high": float(np.percentile(got, 97.5)) if enough else None}
    return out


def bootstrap_by_hash(incidents: DataFrame, times: int, seed: int = SEED) -> DataFrame:
    """Percentile interval of the rate difference over Poisson-weighted incidents; replicates with an empty arm fail. Rows
    are incidents x times: a frame beyond MAX_DEALT is refused, bootstrap_by_strata takes any."""
    _small(incidents.count(), times)
    u = F.conv(F.substring(_digest(seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    w = F.lit(7)
    for j in range(6, -1, -1):
        w = F.when(u < _POISSON[j], F.lit(j)).otherwise(w)
    drawn = incidents.select("incident_id", "k", "n", "exposed", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep")).withColumn("w", w)
    total = lambda c, x: F.sum(F.when(F.col("exposed") == x, F.col("w") * F.col(c)))
    rate = lambda x: total("k", x) / F.when(total("n", x) > 0, total("n", x))
    d = drawn.groupBy("rep").agg((rate(1) - rate(0)).alias("diff"))
    return d.agg(F.count(F.lit(1)).alias("replicates"), (F.count(F.lit(1)) - F.count("diff")).alias("failed"), F.percentile("diff", 0.025).alias("low"), F.percentile("diff", 0.975).alias("high"))


def against_rest(by: DataFrame) -> DataFrame:
    """Rows with k1, n1 completed by k0, n0 of all other rows."""
    whole = by.agg(F.sum("k1").alias("k1"), F.sum("n1").alias("n1")).first()  # one row
    return by.withColumn("k0", F.lit(whole.k1) - F.col("k1")).withColumn("n0", F.lit(whole.n1) - F.col("n1"))


def odds_ratios(rows: DataFrame) -> DataFrame:
    """Log odds ratio with half a count added to each cell, standard error, chi-square of one degree, p."""
    a, b, c, d = F.col("k1") + 0.5, F.col("n1") - F.col("k1") + 0.5, F.col("k0") + 0.5, F.col("n0") - F.col("k0") + 0.5
    out = rows.withColumn("log_or", F.log(a * d / (c * b))).withColumn("se", F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    return out.withColumn("chi", (F.col("log_or") / F.col("se")) ** 2).withColumn("p", two_sided(F.abs(F.col("log_or") / F.col("se"))))


def two_sided(z: Column) -> Column:
    """P(|N(0,1)| >= z), by the rational approximation of erfc with relative error below 1.2e-7."""
    t = 1 / (1 + z / math.sqrt(2) / 2)
    # fixed values: coefficients of the Chebyshev fit of erfc
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    power = F.lit(fit[0])
    for c in fit[1:]:
        power = power * t + c
    return t * F.exp(-(z * z) / 2 + power)


def holm(rows: DataFrame, name: str, p: str = "p") -> DataFrame:
    """Step-down adjustment keyed by name: running maximum of (tests - rank + 1) * p, at most 1. Null p values are no tests.
    Tests are ranked in one task: a family of tests is small, and one beyond MAX_TESTS is refused."""
    rows = rows.where(F.col(p).isNotNull())
    tests = rows.count()
    if tests > MAX_TESTS:
        raise ValueError(f"{tests} tests are no family")
    order = Window.orderBy(F.desc("chi") if "chi" in rows.columns else F.col(p), name)
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("multiplier", F.lit(tests) - F.col("rank") + 1)
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max(F.col("multiplier") * F.col(p)).over(so_far)))


def fisher_frame(totals: DataFrame) -> DataFrame:
    """Exact p of the arms' totals; four numbers reach the driver."""
    r = totals.select("k1", "n1", "k0", "n0").first()
    p = stats.fisher_exact(r.k1, r.n1 - r.k1, r.k0, r.n0 - r.k0)
    return totals.select("k1", "n1", "k0", "n0", F.lit(round(p, 7)).alias("p"))


def discordance(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """2 x 2 table of two outcomes of a pair, matched odds ratio with its Wald interval, exact p; pairs with a null are in
    no cell."""
    t = pairs.agg(*[F.count_if((F.col(x) == i) & (F.col(y) == j)).alias(n) for n, i, j in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))])
    r = t.first()
    b, c = F.col("b"), F.col("c")
    log_or, se = F.log(b / c), F.sqrt(1 / b + 1 / c)
    some = (b > 0) & (c > 0)
    return t.select("a", "b", "c", "d", F.when(c > 0, b / c).alias("odds_ratio"), F.when(some, F.exp(log_or - stats.Z95 * se)).alias("low"), F.when(some, F.exp(log_or + stats.Z95 * se)).alias("high"), F.lit(round(stats.mcnemar_exact(r.b, r.c), 7)).alias("p"))


#: Sizes of both arms up to which the test is exact, if no value is tied.
EXACT_RANKS = 8


def u_counts(n1: int, n0: int) -> list[int]:
    """Of all orders of n1 and n0 rows how many give U = 0, 1, ...: coefficients of the Gaussian binomial."""
    out = [1]
    for i in range(1, n1 + 1):  # times (1 - q^(n0 + i)) / (1 - q^i)
        longer = out + [0] * (n0 + i)
        for j in range(len(longer) - 1, n0 + i - 1, -1):
            longer[j] -= longer[j - n0 - i]
        for j in range(i, len(longer)):
            longer[j] += longer[j - i]
        out = longer[: i * n0 + 1]
    return out


def mann_whitney(rows: DataFrame, value: str, arm: str) -> DataFrame:
    """U of arm 1, its tie-corrected z with and p after continuity correction, two-sided; exact p for small arms without
    ties. Values are counted first, so ranking sorts distinct values only, by few rows for each."""
    g = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(arm) == 1).alias("t1"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("rank", before + (F.col("t") + 1) / 2)
    tied = (F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")
    s = r.agg(F.sum("t1").alias("n1"), (F.sum("t") - F.sum("t1")).alias("n0"), F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum(tied).alias("ties"))
    n1, n0 = F.col("n1"), F.col("n0")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - F.col("ties") / ((n1 + n0) * (n1 + n0 - 1))))
    out = s.select("n1", "n0", "ties", u.alias("u"), F.when(sd > 0, (u - n1 * n0 / 2) / sd).alias("z"), sd.alias("sd"))
    told = out.first()
    p = F.least(F.lit(1.0), two_sided(F.greatest(F.lit(0.0), F.abs(F.col("u") - n1 * n0 / 2) - 0.5) / F.col("sd")))
    if told.n1 and told.n0 and not told.ties and min(told.n1, told.n0) <= EXACT_RANKS and told.n1 * told.n0 <= 10**6:
        counts = u_counts(told.n1, told.n0)
        low = min(told.u, told.n1 * told.n0 - told.u)
        p = F.lit(min(1.0, 2 * sum(counts[: int(low) + 1]) / sum(counts)))
    return out.withColumn("p", F.when(F.col("sd") > 0, p)).drop("ties", "sd")
