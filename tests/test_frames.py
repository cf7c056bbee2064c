"""Models of many frames against dense matrices and plain refits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.operators import frames


def dense_gee(rows, x, exchangeable, rounds=300):
    """rows: (cluster, y, covariates). Iterates V^-1 as whole matrices; the moment estimate of the correlation."""
    z = np.column_stack([np.ones(len(rows)), np.array([r[2] for r in rows], float)])
    y, c = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    groups = [np.flatnonzero(c == g) for g in np.unique(c)]
    p, a = z.shape[1], 0.0
    b = np.zeros(p)
    b[0] = math.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-z @ b))
        r = (y - mu) / np.sqrt(mu * (1 - mu))
        if exchangeable:
            pairs = sum((r[g].sum() ** 2 - (r[g] ** 2).sum()) / 2 for g in groups)
            a = pairs / (sum(len(g) * (len(g) - 1) / 2 for g in groups) - p) / ((r**2).sum() / (len(y) - p))
        bread, meat, score = np.zeros((p, p)), np.zeros((p, p)), np.zeros(p)
        for g in groups:
            v = mu[g] * (1 - mu[g])
            d = z[g] * v[:, None]
            inv = np.linalg.inv(np.sqrt(np.outer(v, v)) * ((1 - a) * np.eye(len(g)) + a))
            bread += d.T @ inv @ d
            s = d.T @ inv @ (y[g] - mu[g])
            score += s
            meat += np.outer(s, s)
        b = b + np.linalg.solve(bread, score)
    inv = np.linalg.inv(bread)
    return b, np.sqrt(np.diag(inv @ meat @ inv)), a


def articles(seed, n=90):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        hot, child, u = int(c % 4 == 0), int(rng.random() < 0.3), rng.normal()
        for _ in range(int(rng.integers(1, 9))):
            kind = ("a", "b", "c")[int(rng.integers(3))]
            q = 1 / (1 + math.exp(-(-0.8 + 0.9 * hot + 0.4 * child + u + 0.5 * (kind == "b"))))
            out.append((c, int(rng.random() < q), hot, child, float(kind == "b"), float(kind == "c"), round(float(rng.normal()), 1)))
    return out


SCHEMA = "incident_id long, outcome int, exposed int, child int, kind_b double, kind_c double, year double"
X = ["exposed", "child", "kind_b", "kind_c", "year"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(articles(1), SCHEMA).repartition(3).cache()


def test_three_frames_at_once_equal_dense_matrices(spark, table):
    rows = table.withColumn("frame", F.explode(F.array(F.lit("all"), F.lit("free"), F.when(F.col("kind_c") == 0, "few").otherwise("rest"))))
    uses = {"all": X, "free": X, "few": ["exposed", "child", "kind_b", "kind_c", "year"], "rest": ["exposed"]}
    found = frames.gee_frames(rows, X, uses, independent={"free"})
    raw = articles(1)
    for f, keep, cols in (("all", lambda r: True, X), ("free", lambda r: True, X), ("few", lambda r: r[5] == 0, ["exposed", "child", "kind_b", "year"]), ("rest", lambda r: r[5] == 1, ["exposed"])):
        at = [2 + X.index(c) for c in cols]
        b, se, a = dense_gee([(r[0], r[1], [r[i] for i in at]) for r in raw if keep(r)], cols, f != "free")
        got = found[f]
        assert got["converged"]
        assert [got["beta"][c] for c in ["intercept", *cols]] == pytest.approx(b, abs=1e-6)
        assert [got["se"][c] for c in ["intercept", *cols]] == pytest.approx(se, abs=1e-6)
        assert got["alpha"] == pytest.approx(a, abs=1e-6)
    assert found["few"]["beta"]["kind_c"] is None  # constant there


def test_a_cluster_of_any_size_and_odd_frames(spark, table):
    rows = table.withColumn("frame", F.lit("one"))
    hot = rows.withColumn("incident_id", F.when(F.col("incident_id") < 30, 0).otherwise(F.col("incident_id")))
    raw = [(0 if r[0] < 30 else r[0], r[1], [r[2]]) for r in articles(1)]
    b, se, a = dense_gee(raw, ["exposed"], True)
    got = frames.gee_frames(hot, ["exposed"])["one"]
    assert (got["beta"]["exposed"], got["se"]["exposed"], got["alpha"]) == pytest.approx((b[1], se[1], a), abs=1e-6)
    odd = spark.createDataFrame([("same", 1, 1, 1), ("same", 2, 1, 0), ("null", 1, None, 1), ("one arm", 1, 1, 1), ("one arm", 2, 0, 1)], "frame string, incident_id long, outcome int, exposed int")
    out = {r.frame: r for r in frames.effects(odd, "exposed").collect()}
    assert set(out) == {"same", "one arm"}
    assert out["same"].log_or is None and out["one arm"].log_or is None and out["one arm"].n == 2
    assert frames.effects(odd.limit(0), "exposed").count() == 0


def test_effects_are_those_of_each_frames_model(spark, table):
    rows = table.withColumn("frame", F.explode(F.array(F.lit("adjusted"), F.lit("plain"))))
    out = {r.frame: r for r in frames.effects(rows, "exposed", {"adjusted": X[1:], "plain": []}).collect()}
    for f, cols in (("adjusted", X), ("plain", X[:1])):
        b, se, a = dense_gee([(r[0], r[1], [r[2 + X.index(c)] for c in cols]) for r in articles(1)], cols, True)
        assert (out[f].log_or, out[f].se, out[f].alpha) == pytest.approx((b[1], se[1], a), abs=1e-6)
        assert out[f].odds_ratio == pytest.approx(math.exp(b[1])) and out[f].exposed_clusters == 23
    assert {r.log_or for r in frames.effects(rows, "exposed", least_rows=10**6).collect()} == {None}


def plain_logit(z, k, n, rounds=60):
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.lstsq((z * (n * mu * (1 - mu))[:, None]).T @ z, z.T @ (k - n * mu), rcond=1e-11)[0]
        b = b + step * min(1, 2 / max(1e-300, np.abs(step).max()))
    return b


def test_bootstrap_equals_refits_of_its_resamples(spark, table, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 7)
    monkeypatch.setattr(frames, "BUCKET", 25)
    got = frames.bootstrap_adjusted(table, "exposed", X[1:], times=50)
    w = {r.c: list(r.w) for r in frames.bootstrap_weights(table.select("incident_id").distinct(), "incident_id", 50, 20260101).collect()}
    assert all(sum(v[r] for v in w.values()) == 90 for r in range(50))
    raw = articles(1)
    z = np.column_stack([np.ones(len(raw)), np.array([r[2:] for r in raw], float)])
    y = np.array([r[1] for r in raw], float)
    want = sorted(plain_logit(z, y * m, m)[1] for m in np.array([w[r[0]] for r in raw], float).T)
    assert got["failed"] == 0 and got["estimates"] == pytest.approx(want, abs=1e-6)
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.exp(np.percentile(want, [2.5, 97.5]))), abs=1e-6)


def test_bootstrap_weights_are_fair_and_the_same_on_any_layout(spark):
    ids = spark.range(400).withColumnRenamed("id", "c")
    a = {r.c: bytes(r.w) for r in frames.bootstrap_weights(ids.repartition(3), "c", 200, 5).collect()}
    assert a == {r.c: bytes(r.w) for r in frames.bootstrap_weights(ids.repartition(1), "c", 200, 5).collect()}
    w = np.array([list(v) for v in a.values()], float)
    assert w.sum(0).tolist() == [400] * 200
    assert abs(w.var() - (1 - 1 / 400)) < 0.03 and abs(np.cov(w[0], w[1])[0, 1] + 1 / 400) < 0.3


def test_bootstrap_without_an_interval(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 0)], "incident_id long, outcome int, exposed int")
    got = frames.bootstrap_adjusted(rows, "exposed", [], times=40)
    assert got["failed"] > 0
    hopeless = frames.bootstrap_adjusted(rows.withColumn("exposed", F.lit(0)), "exposed", [], times=10)
    assert (hopeless["low"], hopeless["failed"]) == (None, 10)
    assert frames.bootstrap_adjusted(rows.limit(0), "exposed", [], times=10)["failed"] == 10
