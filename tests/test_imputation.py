"""Chained equations against a plain version with the same draws; Rubin's rules against their formulas."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.operators import imputation

SEED = 11


def uniform(*parts):
    return (int(hashlib.md5("|".join([str(SEED), *map(str, parts)]).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def logit(z, y):
    b, eye = np.zeros(z.shape[1]), imputation.RIDGE * np.eye(z.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ b))
        info = (z * (mu * (1 - mu))[:, None]).T @ z + eye
        b = b + np.linalg.solve(info, z.T @ (y - mu) - imputation.RIDGE * b)
    return b, np.linalg.inv(info)


def table():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        x = float(rng.normal())
        band = ("a", "b", "c")[int(rng.choice(3, p=(0.3, 0.4, 0.3)) if x < 0 else rng.choice(3, p=(0.1, 0.3, 0.6)))]
        size = 2 + 0.5 * x + (band == "c") + 0.3 * float(rng.normal())
        rows.append((i, x, None if rng.random() < 0.25 else band, None if rng.random() < 0.2 else size))
    return rows


def plain(rows, m, rounds, quantile):
    """The same chain, one imputation after another."""
    out = {}
    levels, shares = ["a", "b", "c"], {}
    seen = [r[2] for r in rows if r[2]]
    shares = np.cumsum([seen.count(v) / len(seen) for v in levels])
    sizes = np.array([r[3] for r in rows if r[3] is not None])
    x = np.array([r[1] for r in rows])
    lost_b, lost_s = np.array([r[2] is None for r in rows]), np.array([r[3] is None for r in rows])
    for i in range(1, m + 1):
        band = np.array([r[2] or levels[int((uniform(0, "band", i, r[0]) >= shares[:-1]).sum())] for r in rows])
        size = np.array([r[3] if r[3] is not None else sizes.mean() + sizes.std(ddof=1) * quantile(uniform(0, "size", i, r[0])) for r in rows])
        for step in range(1, rounds + 1):
            z = np.column_stack([np.ones(len(rows)), size, x])
            b0 = imputation.drawn(*logit(z[~lost_b], (band == "a")[~lost_b].astype(float)), SEED, step, 0, i, 0)
            later = ~lost_b & (band != "a")
            b1 = imputation.drawn(*logit(z[later], (band == "b")[later].astype(float)), SEED, step, 0, i, 1)
            p0, p1 = 1 / (1 + np.exp(-z @ b0)), 1 / (1 + np.exp(-z @ b1))
            for k in np.flatnonzero(lost_b):
                u = uniform(step, "band", i, rows[k][0])
                band[k] = "a" if u < p0[k] else "b" if u < 1 - (1 - p0[k]) * (1 - p1[k]) else "c"
            z = np.column_stack([np.ones(len(rows)), band == "b", band == "c", x]).astype(float)
            zz, y = z[~lost_s], size[~lost_s]
            inv = np.linalg.inv(zz.T @ zz + imputation.RIDGE * np.eye(4))
            b = inv @ zz.T @ y
            rss = y @ y - b @ zz.T @ y
            sigma = math.sqrt(rss / np.random.default_rng([SEED, step, 1, i, 1]).chisquare(len(y) - 4))
            b = imputation.drawn(b, inv * sigma**2, SEED, step, 1, i)
            for k in np.flatnonzero(lost_s):
                size[k] = z[k] @ b + sigma * quantile(uniform(step, "size", i, rows[k][0]))
        out |= {(i, r[0]): (str(band[k]), float(size[k])) for k, r in enumerate(rows)}
    return out


def test_chain_equals_a_plain_one(spark):

    rows = table()
    us = {}

    def quantile(u):
        if u not in us:
            us[u] = _acklam(u)
        return us[u]

    df = spark.createDataFrame(rows, "id long, x double, band string, size double").repartition(3)
    got = imputation.impute(df, "id", ("band",), ("size",), ("x",), m=3, rounds=2, seed=SEED)
    assert got.columns == ["id", "x", "band", "size", "imputation"]
    found = {(r.imputation, r.id): (r.band, r["size"]) for r in got.collect()}
    want = plain(rows, 3, 2, quantile)
    assert found.keys() == want.keys()
    assert [found[k][0] for k in want] == [want[k][0] for k in want]
    assert [found[k][1] for k in want] == pytest.approx([want[k][1] for k in want], abs=1e-6)
    kept = {r[0]: r for r in rows}
    assert all((kept[i][2] in (None, b)) and (kept[i][3] in (None, s)) for (_, i), (b, s) in found.items())


def _acklam(u):
    """The quantile that the library uses, to its precision, by bisection on erfc."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(u)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3.0), (3, None, None)], "id long, band string, size double")
    got = imputation.impute(df, "id", ("band",), ("size",), m=2, rounds=1).collect()
    assert len(got) == 6 and all(r.band is None and r["size"] is not None for r in got)
    assert imputation.impute(df.limit(0), "id", ("band",), ("size",), m=2, rounds=1).count() == 0


def test_rubin():
    r = imputation.rubin([1.0, 1.2, 0.8], [0.1, 0.2, 0.1])
    assert r["estimate"] == pytest.approx(1.0) and r["within"] == pytest.approx(0.02) and r["between"] == pytest.approx(0.04)
    assert r["se"] == pytest.approx(math.sqrt(0.02 + 4 / 3 * 0.04)) and r["df"] == pytest.approx(2 * (1 + 0.02 / (4 / 3 * 0.04)) ** 2)
    assert imputation.rubin([1.0], [0.5])["se"] == 0.5


def test_pooled_effect_is_rubin_over_the_frames(spark):
    from tests.test_frames import SCHEMA, articles, dense_gee

    a, b = articles(1), articles(2)
    df = spark.createDataFrame(a, SCHEMA).withColumn("imputation", F.lit(1)).union(spark.createDataFrame(b, SCHEMA).withColumn("imputation", F.lit(2)))
    fits = [dense_gee([(r[0], r[1], [r[2], r[3]]) for r in rows], None, True) for rows in (a, b)]
    want = imputation.rubin([f[0][1] for f in fits], [f[1][1] for f in fits])
    got = imputation.pooled_effect(df, "exposed", ["child"])
    assert (got["estimate"], got["se"], got["imputations"]) == (pytest.approx(want["estimate"], abs=1e-6), pytest.approx(want["se"], abs=1e-6), 2)
