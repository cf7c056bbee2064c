"""Golden values of the published incident set, derived from its strata (k, n, exposed) -> incidents."""

import math

import pytest
from pyspark.sql import functions as F

from mentionlab.functions import stats
from mentionlab.operators import incidents as inc
from mentionlab.operators import inference, models

STRATA = {(0, 2, 0): 33, (0, 3, 0): 13, (0, 4, 0): 7, (0, 5, 0): 2, (0, 6, 0): 2, (0, 8, 0): 1, (1, 2, 0): 1, (1, 3, 0): 1, (1, 11, 0): 1, (2, 2, 0): 1, (2, 8, 0): 1, (1, 2, 1): 1, (1, 3, 1): 1, (2, 2, 1): 1}


@pytest.fixture(scope="module")
def articles(spark):
    rows, at = [], 0
    for (k, n, x), times in STRATA.items():
        for _ in range(times):
            rows += [(at, j, int(j < k), x, "m", "1") for j in range(n)]
            at += 1
    return spark.createDataFrame(rows, "incident_id long, outlet long, outcome int, exposed int, entity string, tier string")


def test_published_comparison(articles):
    r = inc.compared(inc.arms(inc.to_incidents(articles))).first()
    assert (r.k1, r.n1, r.k0, r.n0, r.i1, r.i0) == (4, 7, 7, 189, 3, 63)
    assert (r.p1_low, r.p1_high) == pytest.approx((0.25045836447486075, 0.8417801447859872), abs=1e-9)
    assert (r.p0_low, r.p0_high) == pytest.approx((0.018054518508354538, 0.07446427351613144), abs=1e-9)
    assert (r["diff"], r.diff_low, r.diff_high) == pytest.approx((0.5343915343915344, 0.21124656416552284, 0.8054087095419702), abs=1e-9)
    assert r.ratio == pytest.approx(15.43, abs=0.005)
    assert stats.fisher_exact(4, 3, 7, 182) == pytest.approx(0.00017719726314781, rel=1e-9)
    level = {x.exposed: x for x in inc.incident_level(inc.to_incidents(articles)).collect()}
    assert (level[1].median, level[1].mean, level[1].share_half) == pytest.approx((0.5, 0.611111, 2 / 3), abs=1e-6)
    assert (level[0].median, level[0].mean, level[0].share_half) == pytest.approx((0.0, 0.034512, 2 / 63), abs=1e-6)


def test_permutation_is_exact_for_few_incidents(articles):
    r = inference.permutation_by_strata(inc.to_incidents(articles))
    assert r["exact"] and r["p"] == pytest.approx(60 / 45760, rel=1e-12)
    assert inference.permutation_by_strata(inc.to_incidents(articles, 12))["p"] is None
    drawn = inference.permutation_by_strata(inc.to_incidents(articles), times=20000, exact_up_to=10)
    assert not drawn["exact"] and drawn["p"] == pytest.approx(60 / 45760, abs=0.001)
    hashed = inference.permutation_by_hash(inc.to_incidents(articles), 2000).first()
    assert hashed.p == pytest.approx(60 / 45760, abs=0.004) and hashed.p > 0


def test_fisher_forms_agree(spark):
    logs = F.array(*[F.lit(x) for x in stats.log_factorials(300)])
    for a, b, c, d in ((10, 90, 5, 95), (45, 55, 25, 75), (3, 7, 8, 2), (1, 9, 9, 1), (4, 3, 7, 182)):
        cols = [F.lit(x).cast("long") for x in (a, b, c, d)]
        assert spark.range(1).select(stats.fisher_column(*cols, logs)).first()[0] == pytest.approx(stats.fisher_exact(a, b, c, d), rel=1e-9)


def test_intervals_have_bounds(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (30, 100), (0, 0)], "k long, n long").select("k", "n", low.alias("l"), high.alias("h")).collect()
    assert rows[0].l == 0 and rows[1].h == 1 and rows[4].l is None
    assert rows[2].l < 0.3 < rows[2].h and rows[3].h - rows[3].l < rows[2].h - rows[2].l


def test_thresholds_count_distinct_outlets(spark):
    rows = [(1, 1, 1, 1, "a", "1"), (1, 1, 0, 1, "a", "1"), (2, 1, 1, 0, "b", "1"), (2, 2, 0, 0, "b", "1"), (3, 1, None, 0, "b", "2"), (3, 2, None, 0, "b", "2"), (4, 1, 1, 0, None, "1"), (4, 2, 1, 0, None, "1")]
    df = spark.createDataFrame(rows, "incident_id long, outlet long, outcome int, exposed int, entity string, tier string")
    assert {r.incident_id for r in inc.to_incidents(df).collect()} == {2}
    assert {r.reason: r.incidents for r in inc.drop_reasons(df, 2, tier="1").collect()} == {"kept": 1, "tier": 1, "entity unknown": 1, "too few outlets": 1}
    empty = inc.compared(inc.arms(inc.to_incidents(df))).first()
    assert empty.p1 is None and empty["diff"] is None


def test_matched_pairs(spark):
    df = spark.createDataFrame([(1, 0)] * 28 + [(0, 1)] * 6 + [(1, None)], "x int, y int")
    r = inference.discordance(df, "x", "y").first()
    assert (r.odds_ratio, r.low, r.high) == pytest.approx((4.667, 1.93, 11.27), abs=0.005)


def test_power(spark):
    n = stats.n_per_arm(F.lit(0.1), F.lit(0.35), F.lit(0.05), F.lit(0.8))
    r = spark.range(1).select(n.alias("n"), (n * stats.design_effect(F.lit(8.0), F.lit(0.5))).alias("c"), stats.normal_quantile(F.lit(0.3)).alias("q")).first()
    assert (r.n, r.c) == pytest.approx((42.598, 191.693), abs=0.001) and math.ceil(r.c / 8) == 24
    assert r.q == pytest.approx(-0.5244005127, abs=1e-8)


def test_holm(spark):
    df = spark.createDataFrame([("a", 9.0, 0.003), ("b", 4.0, 0.045), ("c", 4.1, 0.043), ("d", 0.1, 0.75)], "name string, chi double, p double")
    got = {r.name: r.p_holm for r in inference.holm(df, "name").collect()}
    assert got == pytest.approx({"a": 0.012, "c": 0.129, "b": 0.129, "d": 0.75})
    assert spark.range(1).select(inference.two_sided(F.lit(1.959963985))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_models_recover_effects(spark):
    df = models.simulate(spark, 150, 450, seed=3, effect=1.0, sd=0.7).selectExpr("incident_id", "cast(outcome as double) y", "cast(exposed as double) exposed")
    g = models.gee(df, ["exposed"])
    odds, low, high, p = models.effect(g["beta"][1], g["se"][1])
    assert odds > 1.3 and low < math.exp(1.0) and p < 0.05 and 0 < g["alpha"] < 0.4
    inside = 0
    for seed in range(4, 8):
        null = models.gee(models.simulate(spark, 150, 450, seed=seed, effect=0.0).selectExpr("incident_id", "cast(outcome as double) y", "cast(exposed as double) exposed"), ["exposed"])
        _, low, high, _ = models.effect(null["beta"][1], null["se"][1])
        inside += low < 1 < high
    assert inside >= 3


def test_glm_is_the_hand_odds_ratio(spark):
    df = spark.createDataFrame([(4, 7, 1.0), (7, 189, 0.0)], "k long, n long, exposed double")
    g = models.glm(df, ["exposed"])
    assert math.exp(g["beta"][1]) == pytest.approx((4 / 3) / (7 / 182), rel=1e-6)
    assert models.gee(spark.createDataFrame([(1, 0.0, 1.0)], "incident_id long, y double, exposed double"), ["exposed"])["beta"] == [None, None]


def test_detectable_rate_is_a_bisection_on_clusters(spark):
    def need(p0, p1, m, rho):
        bar, za, zb = (p0 + p1) / 2, 1.9599639845, 0.8416212336
        n = (za * math.sqrt(2 * bar * (1 - bar)) + zb * math.sqrt(p0 * (1 - p0) + p1 * (1 - p1))) ** 2 / (p1 - p0) ** 2
        return math.ceil(n * (1 + (m - 1) * rho) / m)

    rows = [(0.1, k, 8.0, 0.5) for k in (10, 24, 60)] + [(0.3, 2, 4.0, 0.9)]
    df = spark.createDataFrame(rows, "p0 double, k int, m double, rho double")
    got = df.select("p0", "k", "m", "rho", stats.detectable_rate(F.col("p0"), F.col("k"), F.col("m"), F.col("rho"), F.lit(0.05), F.lit(0.8)).alias("rate")).collect()
    for r in got[:3]:
        assert need(r.p0, r.rate, r.m, r.rho) <= r.k < need(r.p0, r.rate - 1e-6, r.m, r.rho)
    assert got[3].rate == pytest.approx(0.999)


def test_resampling_refuses_large_frames(spark):
    df = spark.range(300_000).selectExpr("id AS incident_id", "1L AS k", "2L AS n", "cast(id % 2 AS int) AS exposed")
    for f in (inference.permutation_by_hash, inference.bootstrap_by_hash):
        with pytest.raises(ValueError):
            f(df, 10)
    got = inference.bootstrap_by_strata(df)
    assert got["odds_low"] == pytest.approx(1, abs=0.05) and got["diff_low"] == pytest.approx(0, abs=0.01)


def test_bootstrap_by_strata_agrees_with_drawing_incidents(articles):
    import random

    frame = inc.to_incidents(articles)
    rows = [(r.k, r.n, r.exposed) for r in frame.collect()]
    rng, odds, diffs = random.Random(5), [], []
    for _ in range(4000):
        s = rng.choices(rows, k=len(rows))
        k1, n1 = sum(r[0] for r in s if r[2]), sum(r[1] for r in s if r[2])
        k0, n0 = sum(r[0] for r in s if not r[2]), sum(r[1] for r in s if not r[2])
        if n1 and n0:
            diffs.append(k1 / n1 - k0 / n0)
            if k1 and k0 and n1 > k1 and n0 > k0:
                odds.append(k1 * (n0 - k0) / (k0 * (n1 - k1)))
    got = inference.bootstrap_by_strata(frame, times=4000)
    assert got["diff_failed"] == pytest.approx(4000 - len(diffs), abs=60) and got["odds_failed"] == pytest.approx(4000 - len(odds), abs=200)
    diffs.sort()
    assert got["diff_low"] == pytest.approx(diffs[100], abs=0.03) and got["diff_high"] == pytest.approx(diffs[-100], abs=0.05)


def test_mann_whitney_is_exact_for_small_arms(spark):
    from itertools import combinations

    assert inference.u_counts(3, 4) == [sum(sum(c) - 3 == u for c in combinations(range(7), 3)) for u in range(13)]
    df = spark.createDataFrame([(v, int(v in (1.0, 2.0, 4.0))) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)], "v double, arm int")
    r = inference.mann_whitney(df, "v", "arm").first()
    assert r.u == 1 and r.p == pytest.approx(2 * 2 / 35)
    tied = spark.createDataFrame([(float(i % 5), i % 2) for i in range(40)], "v double, arm int")
    z = inference.mann_whitney(tied, "v", "arm").first()
    assert z.p == pytest.approx(math.erfc((abs(z.u - 200) - 0.5) / abs((z.u - 200) / z.z) / math.sqrt(2)) if z.z else 1.0, abs=1e-6)


def test_two_sided_against_erfc(spark):
    z = [0.0, 0.3, 1.0, 1.96, 3.0, 5.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(inference.two_sided(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], rel=2e-7)


def test_simulation_does_not_depend_on_the_layout(spark):
    a = models.simulate(spark, 40, 160, seed=1)
    b = models.simulate(spark, 40, 160, seed=1).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    try:
        assert sorted(map(tuple, models.simulate(spark, 40, 160, seed=1).collect())) == sorted(map(tuple, a.collect()))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def dense_gee(rows, p, exchangeable=True, rounds=200):
    """GEE with whole matrices: rows (cluster, y, x...), intercept first."""
    import numpy as np

    groups = {}
    for c, y, *x in rows:
        groups.setdefault(c, []).append((y, 1.0, *x))
    data = [(np.array([g[0] for g in v]), np.array([g[1:] for g in v])) for v in groups.values()]
    beta = np.zeros(p)
    mean = np.concatenate([d[0] for d in data]).mean()
    beta[0] = math.log(mean / (1 - mean))
    if exchangeable:
        beta = dense_gee(rows, p, False)[0]
    for _ in range(rounds):
        parts = []
        for y, x in data:
            mu = 1 / (1 + np.exp(-x @ beta))
            parts.append((x, np.sqrt(mu * (1 - mu)), y - mu))
        res = [r / s for _, s, r in parts]
        n = sum(len(r) for r in res)
        phi = sum((r * r).sum() for r in res) / (n - p)
        pairs = sum(len(r) * (len(r) - 1) / 2 for r in res)
        alpha = sum((r.sum() ** 2 - (r * r).sum()) / 2 for r in res) / (pairs - p) / phi if exchangeable else 0.0
        bread, score, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for x, s, r in parts:
            v = np.linalg.inv(np.outer(s, s) * ((1 - alpha) * np.eye(len(s)) + alpha))
            d = x * (s * s)[:, None]
            u = d.T @ v @ r
            bread, score, meat = bread + d.T @ v @ d, score + u, meat + np.outer(u, u)
        step = np.linalg.solve(bread, score)
        beta = beta + step * min(1, 1 / abs(step).max())
        if abs(step).max() < 1e-13:
            break
    inv = np.linalg.inv(bread)
    return beta, np.sqrt(np.diag(inv @ meat @ inv)), alpha


def test_gee_against_dense_matrices(spark):
    df = models.simulate(spark, 30, 60, seed=5).selectExpr("incident_id", "cast(outcome as double) y", "cast(exposed as double) exposed", "cast(deaths as double) deaths")
    rows = [(r.incident_id, r.y, r.exposed, r.deaths) for r in df.collect()]
    for exchangeable in (True, False):
        beta, se, alpha = dense_gee(rows, 3, exchangeable)
        got = models.gee(df, ["exposed", "deaths"], exchangeable=exchangeable)
        assert got["beta"] == pytest.approx(beta.tolist(), abs=1e-8) and got["se"] == pytest.approx(se.tolist(), abs=1e-8)
        assert got["alpha"] == pytest.approx(alpha, abs=1e-8)


def test_published_odds_ratio(spark, articles):
    """The unadjusted model on the published strata of the wider population: 4/7 against 7/294."""
    wide = {**{s: n for s, n in STRATA.items()}, (0, 2, 0): 33 + 22, (0, 3, 0): 13 + 11, (0, 4, 0): 7 + 5, (0, 8, 0): 2}
    rows, at = [], 0
    for (k, n, x), times in wide.items():
        for _ in range(times):
            rows += [(at, float(j < k), float(x)) for j in range(n)]
            at += 1
    beta, se, _ = dense_gee(rows, 2)
    got = models.gee(spark.createDataFrame(rows, "incident_id long, y double, exposed double"), ["exposed"])
    assert got["beta"] == pytest.approx(beta.tolist(), abs=1e-8) and got["se"] == pytest.approx(se.tolist(), abs=1e-8)
    assert 20 < math.exp(got["beta"][1]) < 120
