"""The random-intercept model against a dense integral."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.operators import glmm


def loglik(theta, groups):
    """By the trapezoid rule on a fine grid."""
    u = np.linspace(-8, 8, 3001)
    phi = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    out = 0.0
    for z, y in groups:
        eta = (z @ theta[:-1])[:, None] + theta[-1] * u[None, :]
        out += math.log(np.trapezoid(np.exp((y[:, None] * eta - np.logaddexp(0, eta)).sum(0)) * phi, u))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for c in range(70):
        u, hot = rng.normal() * 1.1, c % 3 == 0
        for _ in range(int(rng.integers(1, 12))):
            x = float(rng.integers(0, 3))
            q = 1 / (1 + math.exp(-(-0.7 + 0.9 * hot + 0.4 * x + u)))
            out.append((c, int(rng.random() < q), int(hot), x))
    return out


SCHEMA = "incident_id long, outcome int, exposed int, x double"


def test_fit_is_the_maximum_of_the_dense_likelihood(spark, rows):
    got = glmm.random_intercept(spark.createDataFrame(rows, SCHEMA).repartition(3), ["exposed", "x"])
    assert got["converged"] and got["clusters"] == 70
    theta = np.array([*got["beta"].values(), got["sigma"]])
    groups = []
    for c in range(70):
        own = [r for r in rows if r[0] == c]
        groups.append((np.array([[1.0, r[2], r[3]] for r in own]), np.array([float(r[1]) for r in own])))
    assert got["loglik"] == pytest.approx(loglik(theta, groups), abs=1e-4)
    e = np.eye(4) * 1e-3
    slope = [(loglik(theta + d, groups) - loglik(theta - d, groups)) / 2e-3 for d in e]
    assert np.abs(slope).max() < 2e-3
    curve = np.array([[(loglik(theta + a + b, groups) - loglik(theta + a - b, groups) - loglik(theta - a + b, groups) + loglik(theta - a - b, groups)) / 4e-6 for b in e] for a in e])
    se = np.sqrt(np.diag(np.linalg.inv(-curve)))
    assert [*got["se"].values(), got["sigma_se"]] == pytest.approx(se, rel=2e-3)


def test_a_large_cluster_and_no_fit(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one = df.withColumn("incident_id", F.when(F.col("incident_id") < 40, 0).otherwise(F.col("incident_id"))).repartition(6)
    other = glmm.random_intercept(one.coalesce(1), ["exposed"])
    again = glmm.random_intercept(one, ["exposed"])
    assert again["converged"] and again["beta"]["exposed"] == pytest.approx(other["beta"]["exposed"], abs=1e-8)
    none = glmm.random_intercept(df.withColumn("outcome", F.lit(1)), ["exposed"])
    assert none["sigma"] is None and not none["converged"]
    assert glmm.random_intercept(df.limit(0), [])["loglik"] is None
