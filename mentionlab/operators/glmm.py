"""Logit model with a random intercept for each cluster, by adaptive Gauss-Hermite quadrature: the cross-check of the GEE.

logit P(y = 1) = x beta + sigma u with u ~ N(0, 1) in each cluster. Its likelihood integrates u out at a few nodes that are
centred and scaled by the cluster's posterior mean and spread of the round before. In a round tasks sum, for each of their
clusters and each node, the log-likelihood, the scores and the information of their rows; a cluster's parts (one for each
task at most, so a cluster of any size is spread) are added where they meet, weighed by the nodes' posterior, and become
sums of (p + 1) x (p + 1) numbers. Clusters that are alike have the same sums: one of each kind is in the rounds, with their
number (kinds.py). Steps are Newton's on the observed information (Louis' form).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.operators import kinds
from mentionlab.operators.models import MAX_LOGIT
from mentionlab.session import written

NODES = 15
_CLUSTER = "c {c}, m double, s double, ll double, g array<double>, h array<double>"


def _expit(eta):
    return 1 / (1 + np.exp(-np.clip(eta, -MAX_LOGIT, MAX_LOGIT)))


def _parts(beta: np.ndarray, sigma: float, z: np.ndarray, xs: list[str]):
    """For each cluster of a batch: log-likelihood, scores and information of its rows at each node, as one flat array."""
    p = len(beta)
    upper = np.triu_indices(p + 1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cs = batch.column("c").to_pylist()
            ids = {c: i for i, c in enumerate(dict.fromkeys(cs))}
            at = np.array([ids[c] for c in cs])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
            take = lambda n: batch.column(n).to_numpy(zero_copy_only=False)[order]  # noqa: E731, B023
            x = np.column_stack([np.ones(len(at)), *[take(c) for c in xs]])
            n, k, m, s, w = (take(c) for c in ("n", "k", "m", "s", "w"))
            out = []
            for node in z:
                u = m + math.sqrt(2) * s * node
                eta = np.clip(x @ beta + sigma * u, -MAX_LOGIT, MAX_LOGIT)
                mu = _expit(eta)
                xu = np.column_stack([x, u])
                one = np.column_stack([k * eta - n * np.logaddexp(0, eta), xu * (k - n * mu)[:, None], xu[:, upper[0]] * xu[:, upper[1]] * (n * mu * (1 - mu))[:, None]])
                out.append(np.add.reduceat(one, first))
            flat = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), batch.schema.field("c").type), pa.array(m[first]), pa.array(s[first]), pa.array(w[first]), pa.array(list(flat), pa.list_(pa.float64()))], ["c", "m", "s", "w", "part"])

    return run


def _clusters(z: np.ndarray, w: np.ndarray, p: int):
    """Of each cluster: posterior mean and spread of u; its log-likelihood, score and observed information times the number of
    clusters of its kind."""
    upper = np.triu_indices(p + 1)
    width = 1 + (p + 1) + len(upper[0])

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("m", "s", "ll", "g", "h")}
            for m, s, many, parts in zip(*(batch.column(c).to_pylist() for c in ("m", "s", "w", "parts")), strict=True):
                a = np.sum(np.array(parts), axis=0).reshape(len(z), width)
                u = m + math.sqrt(2) * s * z
                log = a[:, 0] - u * u / 2 - math.log(2 * math.pi) / 2 + np.log(w) + z * z
                top = log.max()
                weight = np.exp(log - top)
                ll = top + math.log(weight.sum()) + math.log(math.sqrt(2) * s)
                weight = weight / weight.sum()
                score = a[:, 1 : p + 2]
                g = weight @ score
                info = np.zeros((p + 1, p + 1))
                info[upper] = weight @ a[:, p + 2 :]
                info = info + np.triu(info, 1).T - (score * weight[:, None]).T @ score + np.outer(g, g)
                mean = float(weight @ u)
                out["m"].append(mean)
                out["s"].append(max(1e-3, math.sqrt(max(0.0, float(weight @ (u * u)) - mean * mean))))
                out["ll"].append(many * ll)
                out["g"].append((many * g).tolist())
                out["h"].append((many * info).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("c"), *[pa.array(out[n], pa.float64()) for n in ("m", "s", "ll")], *[pa.array(out[n], pa.list_(pa.float64())) for n in "gh"]], ["c", "m", "s", "ll", "g", "h"])

    return run


def _added(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            one = np.concatenate([[batch.column("ll").to_numpy().sum()], *[np.array(batch.column(c).to_pylist()).sum(0) for c in "gh"]])
            total = one if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])


def random_intercept(rows: DataFrame, x: list[str], cluster: str = "incident_id", y: str = "outcome", nodes: int = NODES, rounds: int = 60, tolerance: float = 1e-7) -> dict:
    """Coefficients and standard errors {covariate: value} of the model, sigma and its error, loglik, clusters, converged.

    Rows with a null outcome or covariate are left out; with an outcome that does not vary, or no rows, there is no fit. A
    sigma that runs to zero stops at 1e-3: the model without random intercepts.
    """
    keep = rows.where(F.col(y).isNotNull() & F.col(cluster).isNotNull())
    for c in x:
        keep = keep.where(F.col(c).isNotNull())
    xs = [f"x{i + 1}" for i in range(len(x))]
    data = keep.groupBy(F.col(cluster).alias("c"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, xs, strict=True)]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    data = written(kinds.one_of_each(written(data, "glmm-rows"), [], xs).drop(*kinds.KIND), "glmm")
    one = data.groupBy("c").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.first("w").alias("w"))
    told = one.agg(F.sum(F.col("k") * F.col("w")).alias("k"), F.sum(F.col("n") * F.col("w")).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).cast("long").alias("clusters")).first()
    names, p = ["intercept", *x], len(x) + 1
    if not told.n or not 0 < told.k < told.n:
        return {"beta": dict.fromkeys(names), "se": dict.fromkeys(names), "sigma": None, "sigma_se": None, "loglik": None, "clusters": told.clusters, "converged": False}
    z, w = np.polynomial.hermite.hermgauss(nodes)
    theta = np.zeros(p + 1)
    theta[0], theta[p] = math.log(told.k / (told.n - told.k)), 0.7
    kind = data.schema["c"].dataType.simpleString()
    state = data.select("c").distinct().select("c", F.lit(0.0).alias("m"), F.lit(1.0).alias("s"))
    last, fine = None, False
    for _ in range(rounds):
        placed = data.join(state, "c")
        parts = placed.mapInArrow(_parts(theta[:p], float(theta[p]), z, xs), f"c {kind}, m double, s double, w double, part array<double>")
        met = parts.groupBy("c").agg(F.first("m").alias("m"), F.first("s").alias("s"), F.first("w").alias("w"), F.collect_list("part").alias("parts"))
        found = written(met.mapInArrow(_clusters(z, w, p), _CLUSTER.format(c=kind)), "glmm-clusters")
        sums = np.sum([r.sums for r in found.select("ll", "g", "h").mapInArrow(_added, "sums array<double>").collect()], axis=0)
        ll, g, h = sums[0], sums[1 : p + 2], sums[p + 2 :].reshape(p + 1, p + 1)
        values = np.linalg.eigvalsh(h)
        if values.min() <= 1e-8:  # not yet concave here: a step on the absolute curvature
            v, e = np.linalg.eigh(h)
            step = e @ ((e.T @ g) / np.maximum(np.abs(v), 1e-3))
        else:
            step = np.linalg.solve(h, g)
        state = found.select("c", "m", "s")
        fine = last is not None and np.abs(step).max() < tolerance and abs(ll - last) < 1e-7 * (1 + abs(ll))
        if fine:
            break
        step *= min(1.0, 1.0 / max(1e-300, float(np.abs(step).max())))
        theta = theta + step
        theta[p] = max(1e-3, abs(theta[p]))
        last = ll
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
    return {"beta": dict(zip(names, map(float, theta[:p]), strict=True)), "se": dict(zip(names, map(float, error[:p]), strict=True)), "sigma": float(theta[p]), "sigma_se": float(error[p]), "loglik": float(ll), "clusters": told.clusters, "converged": bool(fine)}
