"""Clustered regression: GEE with robust errors, quasi-binomial GLM, and a two-level simulator.

Every iteration is one aggregation job: clusters are reduced to sums where they lie, and only sums of p x p numbers (p
coefficients) reach the driver, whatever the number of articles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlab.functions.stats import normal_quantile
from mentionlab.session import written


#: Bound of a linear predictor: fits whose arms are separated stay finite.
MAX_LOGIT = 30.0


def _dot(beta: np.ndarray, x: list[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], x):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def _bounded(step: np.ndarray) -> np.ndarray:
    """A Newton step of at most 2 in any coefficient: from a rare outcome's mean a full one overshoots."""
    return step * min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))


def _names(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _matrix(row, p: int, prefix: str) -> np.ndarray:
    m = np.zeros((p, p))
    for i, j in _names(p):
        m[i, j] = m[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
    return m


def gee(rows: DataFrame, x: list[str], cluster: str = "incident_id", y: str = "y", exchangeable: bool = True, rounds: int = 80, tolerance: float = 1e-10) -> dict:
    """Logit GEE of y on x and an intercept: coefficients, robust standard errors, working correlation, clusters.

    With an exchangeable correlation a, V^-1 of a cluster of n is (I - a / (1 + (n - 1) a) J) / (1 - a) in the scaled
    residuals, so a cluster enters through the sums of w x x', of its weighted rows, and of its residuals.
    """
    cols = ["_one", *x]
    p = len(cols)
    data = written(rows.select(F.col(cluster).alias("c"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("_one"), *[F.col(k).cast("double").alias(k) for k in x]), "gee")
    beta, alpha, meat, bread, settled = np.zeros(p), 0.0, None, None, not exchangeable
    mean = data.agg(F.avg("y")).first()[0]
    if mean is None or not 0 < mean < 1:
        return {"beta": [None] * p, "se": [None] * p, "alpha": None, "clusters": data.select("c").distinct().count()}
    beta[0] = math.log(mean / (1 - mean))
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-F.least(F.lit(MAX_LOGIT), F.greatest(F.lit(-MAX_LOGIT), _dot(beta, x)))))
        s = F.sqrt(mu * (1 - mu))
        scaled = data.select("c", ((F.col("y") - mu) / s).alias("r"), *[(F.col(k) * s).alias(f"d{i}") for i, k in enumerate(cols)])
        per = scaled.groupBy("c").agg(
            F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), F.sum(F.col("r") ** 2).alias("srr"), *[F.sum(f"d{i}").alias(f"s{i}") for i in range(p)],
            *[F.sum(F.col(f"d{i}") * F.col("r")).alias(f"u{i}") for i in range(p)], *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"m{i}_{j}") for i, j in _names(p)],
        )
        if exchangeable and settled:
            pairs = per.agg(F.sum((F.col("sr") ** 2 - F.col("srr")) / 2).alias("a"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("b"), F.sum("srr").alias("f"), F.sum("n").alias("n")).first()
            phi = pairs.f / max(1, pairs.n - p)
            alpha = max(-0.1, min(0.95, pairs.a / max(1.0, pairs.b - p) / phi)) if pairs.b else 0.0
        k = F.lit(alpha) / (1 + (F.col("n") - 1) * alpha)
        score = [(F.col(f"u{i}") - k * F.col(f"s{i}") * F.col("sr")) / (1 - alpha) for i in range(p)]
        sums = per.agg(
            *[F.sum(score[i]).alias(f"g{i}") for i in range(p)],
            *[F.sum((F.col(f"m{i}_{j}") - k * F.col(f"s{i}") * F.col(f"s{j}")) / (1 - alpha)).alias(f"b{i}_{j}") for i, j in _names(p)],
            *[F.sum(score[i] * score[j]).alias(f"e{i}_{j}") for i, j in _names(p)], F.count(F.lit(1)).alias("clusters"),
        ).first()
        bread, meat = _matrix(sums, p, "b"), _matrix(sums, p, "e")
        step = _bounded(np.linalg.lstsq(bread, np.array([sums[f"g{i}"] for i in range(p)]), rcond=None)[0])
        beta = beta + step
        if np.abs(step).max() < (tolerance if settled else 1e-3):
            if settled:
                break
            settled = True  # the working correlation is estimated from a fit without it onwards
    inverse = np.linalg.pinv(bread)
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    return {"beta": beta.tolist(), "se": se.tolist(), "alpha": alpha, "clusters": sums.clusters}


def glm(rows: DataFrame, x: list[str], k: str = "k", n: str = "n", rounds: int = 50) -> dict:
    """Binomial logit of k of n on x and an intercept; errors are scaled by Pearson's X2 / df, at least 1."""
    cols = ["_one", *x]
    p = len(cols)
    data = written(rows.where(F.col(n) > 0).select(F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n"), F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in x]), "glm")
    beta = np.zeros(p)
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-F.least(F.lit(MAX_LOGIT), F.greatest(F.lit(-MAX_LOGIT), _dot(beta, x)))))
        w = F.col("n") * mu * (1 - mu)
        r = F.col("k") - F.col("n") * mu
        s = data.agg(*[F.sum(F.col(c) * r).alias(f"g{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j]) * w).alias(f"b{i}_{j}") for i, j in _names(p)], F.sum(r * r / w).alias("x2"), F.count(F.lit(1)).alias("rows")).first()
        bread = _matrix(s, p, "b")
        step = _bounded(np.linalg.lstsq(bread, np.array([s[f"g{i}"] or 0.0 for i in range(p)]), rcond=None)[0])
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    scale = max(1.0, (s.x2 or 0.0) / max(1, s.rows - p))
    return {"beta": beta.tolist(), "se": np.sqrt(np.maximum(np.diag(np.linalg.pinv(bread)) * scale, 0)).tolist(), "scale": scale}


def effect(beta: float | None, se: float | None) -> tuple:
    """Odds ratio, 95 % interval, two-sided p."""
    if beta is None or not se:
        return (None,) * 4
    return math.exp(beta), math.exp(beta - 1.959963985 * se), math.exp(beta + 1.959963985 * se), math.erfc(abs(beta / se) / math.sqrt(2))


def gee_frame(spark: SparkSession, rows: DataFrame, x: list[str]) -> DataFrame:
    g = gee(rows, x)
    return spark.createDataFrame([(n, b, s, *effect(b, s), g["alpha"], g["clusters"]) for n, b, s in zip(["intercept", *x], g["beta"], g["se"])], "term string, beta double, se double, odds_ratio double, low double, high double, p double, alpha double, clusters long")


def glm_frame(spark: SparkSession, rows: DataFrame, x: list[str]) -> DataFrame:
    g = glm(rows, x)
    return spark.createDataFrame([(n, b, s, *effect(b, s), g["scale"]) for n, b, s in zip(["intercept", *x], g["beta"], g["se"])], "term string, beta double, se double, odds_ratio double, low double, high double, p double, scale double")


def _uniform(seed: int, name: str, *columns: str) -> Column:
    """A number in (0, 1) from a digest of a name and columns: the same on any layout of the rows."""
    of = F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), *[F.col(c).cast("string") for c in columns]))
    return (F.conv(F.substring(of, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def simulate(spark: SparkSession, exposed: int, other: int, seed: int = 1, base: float = -1.4, effect: float = 1.0, sd: float = 1.0, mean_articles: float = 8.0) -> DataFrame:
    """Articles of incidents with a random intercept each: incident_id, article, exposed, outcome, outlet, and covariates of
    the incident (year, deaths, kind, child, age_band, multi, remoteness) and of the outlet (register). Every number is
    drawn from a digest of its row's ids, so a seed gives the same frame on any cluster."""
    ids = spark.range(exposed + other).select(F.col("id").alias("incident_id"), (F.col("id") < exposed).cast("int").alias("exposed"))
    pick = lambda name, values: F.get(F.array(*[F.lit(v) for v in values]), F.floor(_uniform(seed, name, "incident_id") * len(values)).cast("int"))
    i = ids.withColumns(
        {
            "u": normal_quantile(_uniform(seed, "u", "incident_id")) * sd,
            "size": F.greatest(F.lit(1), F.round(-F.log(1 - _uniform(seed, "size", "incident_id")) * (mean_articles - 1)).cast("int") + 1),
            "year": pick("year", (2023, 2024, 2025)),
            "deaths": pick("deaths", (0, 0, 0, 1, 1, 2)),
            "kind": pick("kind", ("collision", "fire", "pedestrian")),
            "child": pick("child", (0, 0, 0, 1)),
            "age_band": pick("age_band", ("<=2y", "3-9y", ">=10y")),
            "multi": pick("multi", (0, 1)),
            "remoteness": pick("remoteness", ("metro", "metro", "regional")),
        }
    )
    a = i.select("*", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("article")).drop("size")
    a = a.withColumn("outlet", F.floor(_uniform(seed, "outlet", "incident_id", "article") * 9).cast("int"))
    p = 1 / (1 + F.exp(-(F.lit(base) + effect * F.col("exposed") + F.col("u") + 0.3 * F.col("deaths"))))
    outcome = (_uniform(seed, "outcome", "incident_id", "article") < p).cast("int")
    return a.withColumns({"outcome": outcome, "register": F.when(F.col("outlet") < 5, "tabloid").otherwise("broadsheet")}).drop("u")
