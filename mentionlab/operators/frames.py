"""Adjusted models of many frames at once: exchangeable or independent GEE, and the bootstrap of the adjusted model.

A frame is a subset of the rows with a name, a set of covariates and a working correlation. All frames are fitted by the
same jobs. Rows with equal cluster and covariates are counted first, and of clusters that are alike one is kept with their
number (kinds.py). A round sums each cluster's residuals and weighted
covariates (2 p + 3 numbers, summed where they lie, so a cluster of any size is spread), turns clusters into sums of p x p
numbers in each task, and adds these on the driver: p x p numbers for each frame and task, whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.functions.stats import Z95
from mentionlab.operators import kinds
from mentionlab.operators.models import MAX_LOGIT
from mentionlab.session import written

#: Frames that are fitted at once, at most.
MAX_FRAMES = 2_000
_SUMS = "frame string, kind string, m array<double>"


def _expit(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -MAX_LOGIT, MAX_LOGIT)))


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) if names else np.zeros((batch.num_rows, 0))


def _emitted(found: dict[tuple[str, str], np.ndarray]):
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], ["frame", "kind", "m"])


def _by_frame(batches, add):
    """What `add` makes of each frame's part of each batch ({kind: array}), summed over a task."""
    found: dict[tuple[str, str], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            names = np.array(batch.column("frame").to_pylist(), object)
            for f in dict.fromkeys(names):
                for kind, a in add(f, batch.filter(pa.array(names == f))).items():
                    found[f, kind] = found[f, kind] + a if (f, kind) in found else a
    yield from _emitted(found)


class _State:
    """Coefficients and working correlations of the frames between rounds."""

    def __init__(self, names: list[str], p: int):
        self.beta = {f: np.zeros(p) for f in names}
        self.alpha = dict.fromkeys(names, 0.0)
        self.open = set(names)


def _collected(df: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    out: dict[tuple[str, str], np.ndarray] = {}
    for r in df.toLocalIterator():
        m = np.array(r.m)
        out[r.frame, r.kind] = out[r.frame, r.kind] + m if (r.frame, r.kind) in out else m
    return out


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=1e-11)[0]


def gee_frames(rows: DataFrame, x: list[str], frames: dict[str, list[str]] | None = None, by: str = "frame", cluster: str = "incident_id", y: str = "outcome", independent: frozenset[str] | set[str] = frozenset(), rounds: int = 100, tolerance: float = 1e-9) -> dict[str, dict]:
    """Logit GEE of y on an intercept and covariates in each frame, with robust errors.

    x: all covariates; frames: {frame: those it uses} (all by default, in frames that rows name). The working correlation is
    exchangeable, but for frames in `independent`. For each frame: beta and se {covariate: value} (None where the frame has
    no estimate of it), alpha, n, clusters, converged. Rows with a null outcome or covariate are left out. A covariate
    that is constant in a frame, or follows from others, has no estimate and changes no other one. A frame whose outcome
    does not vary has no estimates.
    """
    return _fitted(_counted(rows.where(F.col(y).isNotNull()), x, frames, by, cluster, y), x, frames, independent, rounds, tolerance)


def _counted(rows: DataFrame, x: list[str], frames: dict[str, list[str]] | None, by: str, cluster: str, y: str) -> DataFrame:
    """frame, c, x1, x2, ..., n, k of one cluster of each kind, with w, how many are of it."""
    if frames is not None:  # what a frame does not use splits none of its rows and excludes none
        rows = rows.withColumns({c: F.when(F.col(by).cast("string").isin([f for f, used in frames.items() if c in used]), F.col(c).cast("double")).otherwise(0.0) for c in x})
    xs = [f"x{i + 1}" for i in range(len(x))]
    data = rows.groupBy(F.col(by).cast("string").alias("frame"), F.col(cluster).alias("c"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, xs, strict=True)])
    data = written(data.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("k")), "gee-rows")
    return written(kinds.one_of_each(data, ["frame"], xs).drop(*kinds.KIND), "gee-frames")


def _fitted(data: DataFrame, x: list[str], frames: dict[str, list[str]] | None, independent: frozenset[str] | set[str] = frozenset(), rounds: int = 100, tolerance: float = 1e-9) -> dict[str, dict]:
    """gee_frames of what _counted made."""
    p = 1 + len(x)
    for i in range(1, p):
        data = data.where(F.col(f"x{i}").isNotNull())
    one = data.groupBy("frame", "c").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("w").alias("w"))
    found = one.groupBy("frame").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("k") * F.col("w")).alias("k"), F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("w"))), F.lit(0.0)).cast("long").alias("clusters"), F.max("n").alias("largest"))
    facts = {r.frame: r for r in found.limit(MAX_FRAMES + 1).collect()}
    if len(facts) > MAX_FRAMES:
        raise ValueError(f"more than {MAX_FRAMES} frames")
    largest = {f: r.largest for f, r in facts.items()}
    uses = {f: np.array([True, *[frames is None or c in frames.get(f, ()) for c in x]]) for f in facts}
    state = _State([f for f, r in facts.items() if 0 < r.k < r.n], p)
    for f in state.open:
        state.beta[f][0] = math.log(facts[f].k / (facts[f].n - facts[f].k))
    xs = [f"x{i}" for i in range(1, p)]
    ended: dict[str, dict] = {}
    rank: dict[str, int] = {}
    for _ in range(rounds):
        if not state.open:
            break
        sums = _round(data, xs, state, uses)
        for f in sorted(state.open):
            ok, alpha = uses[f], state.alpha[f]
            cut = lambda m: m.reshape(p, p)[np.ix_(ok, ok)]  # noqa: E731, B023
            bread = (cut(sums[f, "rows"]) - cut(sums[f, "bread"])) / (1 - alpha)
            if f not in rank:
                rank[f] = int(np.linalg.matrix_rank(cut(sums[f, "rows"]), tol=1e-9 * max(1.0, np.abs(sums[f, "rows"]).max())))
            step = np.zeros(p)
            step[ok] = _solved(bread, sums[f, "score"][ok])
            step *= min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))
            pairs, several, square, n = sums[f, "pairs"]
            free = several - rank[f]
            new = pairs / max(1.0, free) / (square / max(1.0, n - rank[f])) if f not in independent and several else 0.0
            new = float(min(0.999, max(new, -0.999 / max(1.0, largest[f] - 1))))
            if np.abs(step).max() < tolerance and abs(new - alpha) < tolerance:
                ended[f] = {"bread": bread, "meat": cut(sums[f, "meat"]), "converged": True}
            else:
                ended[f] = {"bread": bread, "meat": cut(sums[f, "meat"]), "converged": False}
                state.beta[f], state.alpha[f] = state.beta[f] + step, new
                continue
            state.open.discard(f)
    out = {}
    for f, r in facts.items():
        found = {"beta": dict.fromkeys(["intercept", *x]), "se": dict.fromkeys(["intercept", *x]), "alpha": None, "n": int(r.n), "clusters": r.clusters, "converged": False}
        if f in ended:
            e, ok = ended[f], uses[f]
            inverse = np.linalg.pinv(e["bread"], rcond=1e-11)
            se = np.sqrt(np.maximum(np.diag(inverse @ e["meat"] @ inverse), 0))
            known = np.abs(inverse @ e["bread"] - np.eye(len(inverse))).max(1) < 1e-6  # identified: its row of the projection is a unit vector
            names = [c for c, u in zip(["intercept", *x], ok, strict=True) if u]
            for c, b, s, i in zip(names, state.beta[f][ok], se, known, strict=True):
                if i:
                    found["beta"][c], found["se"][c] = float(b), float(s)
            found |= {"alpha": state.alpha[f], "converged": e["converged"]}
        out[f] = found
    return out


def _round(data: DataFrame, xs: list[str], state: _State, uses: dict[str, np.ndarray]) -> dict[tuple[str, str], np.ndarray]:
    """The sums of all open frames at their present coefficients."""
    spark, p = data.sparkSession, len(xs) + 1
    beta, alpha = {f: state.beta[f] for f in state.open}, {f: state.alpha[f] for f in state.open}
    table = spark.createDataFrame([(f, *map(float, b)) for f, b in beta.items()], "frame string, " + ", ".join(f"b{i} double" for i in range(p)))
    own = data.join(F.broadcast(table), "frame")  # at most MAX_FRAMES rows
    eta = F.col("b0")
    for i in range(1, p):
        eta = eta + F.col(f"b{i}") * F.col(f"x{i}")
    mu = 1 / (1 + F.exp(-F.least(F.lit(MAX_LOGIT), F.greatest(F.lit(-MAX_LOGIT), eta))))
    own = own.withColumn("mu", mu).withColumn("s", F.sqrt(F.col("mu") * (1 - F.col("mu")))).select("frame", "c", "n", "k", "w", "mu", "s", *xs)
    res = F.col("k") - F.col("n") * F.col("mu")
    square = (F.col("k") * (1 - F.col("mu")) ** 2 + (F.col("n") - F.col("k")) * F.col("mu") ** 2) / F.col("s") ** 2
    per = own.groupBy("frame", "c").agg(
        F.first("w").alias("w"), F.sum("n").alias("n"), F.sum(res / F.col("s")).alias("sr"), F.sum(square).alias("srr"), F.sum(F.col("n") * F.col("s")).alias("s0"), F.sum(res).alias("u0"),
        *[F.sum(F.col("n") * F.col("s") * F.col(c)).alias(f"s{i + 1}") for i, c in enumerate(xs)], *[F.sum(res * F.col(c)).alias(f"u{i + 1}") for i, c in enumerate(xs)],
    )

    def clusters(batches):
        def add(f, b):
            w, n, sr, srr = (b.column(c).to_numpy() for c in ("w", "n", "sr", "srr"))
            s, u = (_columns(b, [f"{c}{i}" for i in range(p)]) for c in "su")
            k = alpha[f] / (1 + (n - 1) * alpha[f])
            score = (u - (k * sr)[:, None] * s) / (1 - alpha[f])
            return {"bread": (s * (w * k)[:, None]).T @ s, "score": w @ score, "meat": (score * w[:, None]).T @ score, "pairs": np.array([w @ (sr**2 - srr) / 2, w @ (n * (n - 1)) / 2, w @ srr, w @ n])}

        return _by_frame(batches, add)

    def weights(batches):
        def add(f, b):
            z = np.column_stack([np.ones(b.num_rows), _columns(b, xs)])
            mu = _expit(z @ beta[f])
            return {"rows": (z * (b.column("n").to_numpy() * b.column("w").to_numpy() * mu * (1 - mu))[:, None]).T @ z}

        return _by_frame(batches, add)

    open_rows = data.join(F.broadcast(table.select("frame")), "frame")
    return _collected(per.mapInArrow(clusters, _SUMS).unionByName(open_rows.mapInArrow(weights, _SUMS)))


_EFFECTS = "frame string, n long, clusters long, exposed_clusters long, log_or double, se double, odds_ratio double, low double, high double, p double, alpha double"


def effects(rows: DataFrame, exposure: str, covariates: list[str] | dict[str, list[str]] = (), by: str = "frame", cluster: str = "incident_id", y: str = "outcome", independent: frozenset[str] | set[str] = frozenset(), least_rows: int = 0, least_exposed: int = 0) -> DataFrame:
    """The exposure's effect in each frame, adjusted and exchangeable: n, clusters, exposed_clusters, log_or, se, odds_ratio,
    low, high, p, alpha. covariates: those of all frames, or {frame: its own}. Estimates are null where a frame is below the
    gates, has one arm only, or does not settle."""
    spark = rows.sparkSession
    frames = {f: [exposure, *c] for f, c in covariates.items()} if isinstance(covariates, dict) else None
    x = [exposure, *(dict.fromkeys(c for cs in covariates.values() for c in cs) if isinstance(covariates, dict) else covariates)]
    rows = rows.where(F.col(y).isNotNull() & F.col(exposure).isNotNull())
    data = _counted(rows, x, frames, by, cluster, y)
    arm = F.col("x1").cast("int")
    own = data.groupBy("frame", "c").agg(F.sum("n").alias("n"), F.first("w").alias("w"), F.max(arm).alias("hot"), F.min(arm).alias("cold"))
    own = own.groupBy("frame").agg(F.sum(F.col("n") * F.col("w")).cast("long").alias("n"), F.sum("w").cast("long").alias("clusters"), F.coalesce(F.sum(F.when(F.col("hot") == 1, F.col("w"))), F.lit(0.0)).cast("long").alias("exposed"), F.max("hot").alias("hot"), F.min("cold").alias("cold"))
    told = {r.frame: r for r in own.limit(MAX_FRAMES + 1).collect()}
    if len(told) > MAX_FRAMES:
        raise ValueError(f"more than {MAX_FRAMES} frames")
    fits = [f for f, r in told.items() if r.n >= least_rows and r.exposed >= least_exposed and r.hot != r.cold]
    found = _fitted(data.where(F.col("frame").isin(fits)), x, frames, independent) if fits else {}
    out = []
    for f, r in sorted(told.items()):
        g = found.get(f)
        b, s = (g["beta"][exposure], g["se"][exposure]) if g and g["converged"] else (None, None)
        known = b is not None and s is not None and s > 0
        out.append((f, r.n, r.clusters, r.exposed, *((b, s, math.exp(b), math.exp(b - Z95 * s), math.exp(b + Z95 * s), math.erfc(abs(b / s) / math.sqrt(2)), g["alpha"]) if known else (None,) * 7)))
    return spark.createDataFrame(out, _EFFECTS)


#: Replicates in one block of the bootstrap, incidents in one bucket.
BLOCK, BUCKET = 100, 20_000


def _draws(buckets: dict[int, int], times: int, seed: int) -> dict[int, np.ndarray]:
    """How many incidents each bucket gives to each replicate."""
    order = sorted(buckets)
    sizes = np.array([buckets[b] for b in order], float)
    drawn = np.random.default_rng(seed).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=times)
    return {b: drawn[:, i] for i, b in enumerate(order)}


def bootstrap_weights(ids: DataFrame, cluster: str, times: int, seed: int) -> DataFrame:
    """cluster, w: how often each cluster is in each of `times` resamples of all clusters with replacement, as bytes (255 at
    most; a count beyond has a probability below 1e-300). Resampling is a multinomial draw over buckets of about BUCKET
    clusters, then one within each, from seeds of the bucket: the same on any layout."""
    placed, drawn = _placed(ids.select(F.col(cluster).alias("c")), times, seed)

    def weigh(key, part):
        part = part.sort_values("c", ignore_index=True)
        w = _bucket_weights(seed, int(key[0]), drawn, len(part)).astype(np.uint8)
        part["w"] = [w[:, i].tobytes() for i in range(len(part))]
        return part[["c", "w"]]

    return placed.groupBy("bucket").applyInPandas(weigh, f"c {placed.schema['c'].dataType.simpleString()}, w binary")


def _placed(ids: DataFrame, times: int, seed: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """ids(c, ...) with their bucket, and what each bucket gives to each replicate."""
    buckets = max(1, -(-ids.count() // BUCKET))
    placed = ids.withColumn("bucket", F.pmod(F.xxhash64("c"), F.lit(buckets)).cast("int"))
    return placed, _draws({r.bucket: r["count"] for r in placed.groupBy("bucket").count().collect()}, times, seed)


def _bucket_weights(seed: int, bucket: int, drawn: dict[int, np.ndarray], n: int) -> np.ndarray:
    """times x n: how often each of a bucket's clusters, in their order, is in each replicate."""
    rng = np.random.default_rng([seed, bucket])
    return np.stack([rng.multinomial(m, np.full(n, 1 / n)).astype(np.uint32) for m in drawn[bucket]])


#: Rows of weights that are added in one task.
ADDED = 10_000


def _packed(w: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    return w.astype(next((t for t in ("u1", "<u2", "<u4") if w.max(initial=0) <= np.iinfo(t).max), "<u8")).tobytes()


def _unpacked(w: bytes, times: int) -> np.ndarray:
    return np.frombuffer(w, f"<u{memoryview(w).nbytes // times}")


def _kind_weights(ids: DataFrame, times: int, seed: int) -> DataFrame:
    """The weights of bootstrap_weights, added over the clusters of each kind: ids(c, kind) -> kind, w (packed). A bucket adds
    its own kinds before anything is written."""
    key = list(kinds.KIND)
    shown = ", ".join(f"{n} {ids.schema[n].dataType.simpleString()}" for n in key)
    placed, drawn = _placed(ids, times, seed)

    def added(part, w):
        of = part.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) != 0)))
        out = part.iloc[order[first]][key].reset_index(drop=True)
        out["w"] = [_packed(v) for v in np.add.reduceat(w[order], first, axis=0)]
        return out

    def within(bucket, part):
        part = part.sort_values("c", ignore_index=True)
        return added(part, _bucket_weights(seed, int(bucket[0]), drawn, len(part)).T.astype(np.int64))

    def across(part):
        return added(part, np.stack([_unpacked(w, times) for w in part["w"]]).astype(np.int64))

    found = written(placed.groupBy("bucket").applyInPandas(within, f"{shown}, w binary"), "bootstrap-weights")
    some = max(1, -(-found.count() // ADDED))
    tasks = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), some // 8)
    laid = found.withColumn("part", F.pmod(F.col("kind_a"), F.lit(some))).repartition(tasks, "part")
    return laid.groupBy("part").applyInPandas(lambda key, part: across(part), f"{shown}, w binary")


def bootstrap_adjusted(rows: DataFrame, exposure: str, x: list[str], cluster: str = "incident_id", y: str = "outcome", times: int = 1000, seed: int = 20260101, rounds: int = 40) -> dict:
    """Percentile interval of the adjusted odds ratio over clusters drawn with replacement, refitted with an independence
    working correlation: low, high, replicates, failed, estimates (sorted log odds ratios).

    All replicates are refitted at once: clusters that are alike carry the sum of their weights (kinds.py), a round is
    two matrix products for each batch of rows, and a block of BLOCK replicates is solved in one task of its own. A
    replicate fails if an arm or an outcome of an arm is missing in it, or its exposure has no estimate; if half of them
    fail there is no interval. Rows with a null outcome or covariate are left out.
    """
    names = [exposure, *x]
    keep = rows.where(F.col(y).isNotNull())
    for c in names:
        keep = keep.where(F.col(c).isNotNull())
    data = keep.groupBy(F.col(cluster).alias("c"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    data = written(data, "bootstrap-rows")
    if data.isEmpty():
        return {"low": None, "high": None, "replicates": times, "failed": times, "estimates": []}
    ids = kinds.of_clusters(data, [], [f"x{i + 1}" for i in range(len(names))])
    ids = written(ids.withColumn("kind_d", F.when(F.col("c").isNotNull(), F.col("kind_d")).otherwise(-1)), "bootstrap-clusters")  # drawn, without rows
    rows = data.join(ids.groupBy(*kinds.KIND).agg(F.min("c").alias("c")), "c")
    own = written(rows.join(_kind_weights(ids, times, seed), list(kinds.KIND)).drop("c", *kinds.KIND), "bootstrap-weighted")
    xs, p = [f"x{i + 1}" for i in range(len(names))], len(names) + 1
    upper = np.triu_indices(p)
    mean = data.agg((F.sum("k") / F.sum("n")).alias("m")).first().m
    betas = np.zeros((times, p))
    betas[:, 0] = math.log(mean / (1 - mean)) if 0 < mean < 1 else 0.0
    blocks = [(a, min(a + BLOCK, times)) for a in range(0, times, BLOCK)]
    cells = _cells(own, times)
    failed = (cells <= 0).any(1)
    going = ~failed
    for _ in range(rounds):
        if not going.any():
            break
        now, some = betas.copy(), [b for b in blocks if going[b[0] : b[1]].any()]

        def partial(batches, now=now, some=some):
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = np.column_stack([np.ones(batch.num_rows), _columns(batch, xs)])
                n, k = (batch.column(c).to_numpy() for c in "nk")
                w = np.stack([_unpacked(v.as_buffer(), times) for v in batch.column("w")])
                zz = z[:, upper[0]] * z[:, upper[1]]
                for a, b in some:
                    own_w = w[:, a:b].astype(float)
                    mu = _expit(z @ now[a:b].T)
                    g = (own_w * (k[:, None] - n[:, None] * mu)).T @ z
                    h = (own_w * n[:, None] * mu * (1 - mu)).T @ zz
                    found[a] = found.get(a, 0) + np.hstack([g, h])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([m.astype("<f8").tobytes() for m in found.values()], pa.binary())], ["block", "sums"])

        def solve(part):
            sums = sum(np.frombuffer(s, "<f8") for s in part["sums"]).reshape(-1, p + len(upper[0]))
            steps = []
            for s in sums:
                m = np.zeros((p, p))
                m[upper] = s[p:]
                m = m + np.triu(m, 1).T
                steps.append(_solved(m, s[:p]))
            part = part.head(1)[["block"]]
            part["steps"] = [np.array(steps).astype("<f8").tobytes()]
            return part

        for r in own.mapInArrow(partial, "block int, sums binary").groupBy("block").applyInPandas(solve, "block int, steps binary").collect():
            step = np.frombuffer(r.steps, "<f8").reshape(-1, p)
            at = np.arange(r.block, r.block + len(step))
            size = np.abs(step).max(1)
            step = step * np.minimum(1.0, 2.0 / np.maximum(size, 1e-300))[:, None]
            moved = going[at]
            betas[at[moved]] += step[moved]
            going[at[moved & (size < 1e-9)]] = False
    failed |= going
    got = np.sort(betas[~failed, 1])
    enough = len(got) >= times * 0.5 and len(got) > 0
    low, high = (math.exp(float(v)) for v in np.percentile(got, [2.5, 97.5])) if enough else (None, None)
    return {"low": low, "high": high, "replicates": times, "failed": int(failed.sum()), "estimates": got.tolist()}


def _cells(own: DataFrame, times: int) -> np.ndarray:
    """Rows with and without the outcome in either arm, in each replicate."""

    def count(batches):
        total = np.zeros((times, 4))
        for batch in batches:
            if batch.num_rows:
                n, k, x = (batch.column(c).to_numpy() for c in ("n", "k", "x1"))
                w = np.stack([_unpacked(v.as_buffer(), times) for v in batch.column("w")]).astype(float)
                total += w.T @ np.column_stack([k * (x > 0), (n - k) * (x > 0), k * (x <= 0), (n - k) * (x <= 0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["cells"])

    return sum((np.frombuffer(r.cells, "<f8").reshape(times, 4) for r in own.mapInArrow(count, "cells binary").toLocalIterator()), np.zeros((times, 4)))

