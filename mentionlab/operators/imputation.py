"""Multiple imputation by chained equations, and Rubin's rules over the imputed frames.

All m imputations run side by side as frames of one table (rows times m). In a round each incomplete column is fitted on its
observed rows given the others' present values, in all imputations at once: tasks sum p x p numbers for each frame, which
the driver adds and solves. Coefficients are drawn from their posterior, values from the model by a digest of seed, round,
column, imputation and row key: the same on any layout. Categories are drawn level by level (a logit of each level
against those after it), numbers from a linear model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.functions.stats import normal_quantile
from mentionlab.operators.models import MAX_LOGIT
from mentionlab.session import written

IMPUTATIONS, ROUNDS, SEED = 20, 5, 20260101
#: Levels of a category at most.
MAX_LEVELS = 50
#: A little weight that keeps separated or empty fits finite.
RIDGE = 1e-4


def _uniform(seed: int, *parts: Column | str) -> Column:
    of = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return (F.conv(F.substring(of, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def drawn(mean: np.ndarray, cov: np.ndarray, seed: int, *parts: int) -> np.ndarray:
    """A draw from a normal distribution, by seed."""
    z = np.random.default_rng([seed, *parts]).standard_normal(len(mean))
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return mean + vectors @ (np.sqrt(np.maximum(values, 0)) * z)


def _summed(data: DataFrame, x: list[str], state: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """For each frame of data(frame, y, x...): X'WX, X'(y - mu) (or X'y), y'y, n as one array; no state means a linear model."""
    p = len(x) + 1

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            names = np.array(b.column("frame").to_pylist(), object)
            z = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False) for c in x]])
            y = b.column("y").to_numpy(zero_copy_only=False)
            for f in dict.fromkeys(names):
                at = names == f
                zf, yf = z[at], y[at]
                if state is None:
                    one = np.concatenate([(zf.T @ zf).ravel(), zf.T @ yf, [yf @ yf, len(yf)]])
                else:
                    mu = 1 / (1 + np.exp(-np.clip(zf @ state[f], -MAX_LOGIT, MAX_LOGIT)))
                    one = np.concatenate([((zf * (mu * (1 - mu))[:, None]).T @ zf).ravel(), zf.T @ (yf - mu), [0.0, len(yf)]])
                found[f] = found.get(f, 0) + one
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["frame", "sums"])

    out: dict[str, np.ndarray] = {}
    for r in data.select("frame", "y", *x).mapInArrow(run, "frame string, sums array<double>").toLocalIterator():
        out[r.frame] = out.get(r.frame, np.zeros(p * p + p + 2)) + np.array(r.sums)
    return out


def logit_frames(data: DataFrame, x: list[str], frames: list[str], rounds: int = 40) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{frame: (coefficients, covariance)} of the logit of y in each frame, with a ridge of RIDGE."""
    p = len(x) + 1
    state = {f: np.zeros(p) for f in frames}
    cov = {f: np.eye(p) / RIDGE for f in frames}
    going = set(frames)
    for _ in range(rounds):
        sums = _summed(data, x, state)
        going &= set(sums)
        for f in sorted(going):
            info = sums[f][: p * p].reshape(p, p) + RIDGE * np.eye(p)
            step = np.linalg.solve(info, sums[f][p * p : p * p + p] - RIDGE * state[f])
            step *= min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))
            state[f], cov[f] = state[f] + step, np.linalg.inv(info)
            if np.abs(step).max() < 1e-8:
                going.discard(f)
        if not going:
            break
    return {f: (state[f], cov[f]) for f in frames}


def linear_frames(data: DataFrame, x: list[str], frames: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, float, int]]:
    """{frame: (coefficients, (X'X)^-1, residual sum of squares, rows)} of the linear model of y in each frame."""
    p = len(x) + 1
    sums = _summed(data, x, None)
    out = {}
    for f in frames:
        s = sums.get(f, np.zeros(p * p + p + 2))
        inv = np.linalg.inv(s[: p * p].reshape(p, p) + RIDGE * np.eye(p))
        b = inv @ s[p * p : p * p + p]
        out[f] = (b, inv, max(0.0, float(s[-2] - b @ s[p * p : p * p + p])), int(s[-1]))
    return out


def _dummies(c: str, levels: list[str]) -> dict[str, Column]:
    return {f"_{c}_{k}": (F.col(c) == v).cast("double") for k, v in enumerate(levels[1:])}


def _eta(betas: str, x: list[str]) -> Column:
    out = F.get(F.col(betas), F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get(F.col(betas), F.lit(i + 1)) * F.col(c)
    return out


def impute(rows: DataFrame, key: str, categories: tuple[str, ...] = (), numbers: tuple[str, ...] = (), complete: tuple[str, ...] = (), m: int = IMPUTATIONS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """rows m times, with `imputation` (1 to m), nulls of the listed categories (as strings) and numbers filled in.

    complete: numeric columns that only predict (a null of theirs counts as 0). The key must tell rows apart. Columns are
    taken in the order given, categories first. A column without any value stays null; one without nulls stays as it is.
    """
    spark = rows.sparkSession
    columns = [*categories, *numbers]
    missing = {c: f"_missing_{c}" for c in columns}
    base = rows.withColumns({c: F.col(c).cast("string") for c in categories} | {c: F.col(c).cast("double") for c in numbers} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in complete})
    base = written(base.withColumns({n: F.col(c).isNull() for c, n in missing.items()}), "imputation")
    levels: dict[str, list[str]] = {}
    shares: dict[str, list[float]] = {}
    for c in categories:
        found = base.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        levels[c], total = [r[0] for r in found], sum(r["count"] for r in found)
        shares[c] = np.cumsum([r["count"] / total for r in found]).tolist()
    told = base.agg(*[F.avg(c).alias(f"a_{c}") for c in numbers], *[F.coalesce(F.stddev(c), F.lit(0.0)).alias(f"s_{c}") for c in numbers], *[F.count_if(n).alias(n) for n in missing.values()], F.count(F.lit(1)).alias("rows")).first()
    data = base.withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m))))
    fill = {}
    for c in columns:
        u = _uniform(seed, "0", c, F.col("imputation"), F.col(key))
        if c in levels and levels[c]:
            pick = F.lit(levels[c][-1])
            for v, s in reversed(list(zip(levels[c][:-1], shares[c][:-1], strict=True))):
                pick = F.when(u < s, v).otherwise(pick)
        elif c in levels or told[f"a_{c}"] is None:
            continue
        else:
            pick = F.lit(float(told[f"a_{c}"])) + F.lit(float(told[f"s_{c}"])) * normal_quantile(u)
        fill[c] = F.coalesce(F.col(c), pick)
    data = written(data.withColumns(fill), "imputation-start")
    todo = [c for c in columns if told[missing[c]] and c in fill]
    names = [str(i) for i in range(1, m + 1)]
    for step in range(1, rounds + 1):
        for at, c in enumerate(todo):
            others = {k: v for o in categories if o != c for k, v in _dummies(o, levels[o]).items()}
            x = [*others, *[o for o in numbers if o != c and o in fill], *complete]
            frame = F.col("imputation").cast("string")
            made = data.withColumns(others)
            seen = made.where(~F.col(missing[c]))
            u = _uniform(seed, str(step), c, F.col("imputation"), F.col(key))
            if c in levels:
                cuts = levels[c][:-1]
                rank = F.array_position(F.array(*map(F.lit, levels[c])), F.col(c))
                fits = seen.select(F.explode(F.sequence(F.lit(1), F.least(rank, F.lit(len(cuts)).cast("long")).cast("int"))).alias("cut"), rank.alias("rank"), "imputation", *x) if cuts else None
                if not cuts:
                    continue
                fits = written(fits.select(F.concat_ws("/", "imputation", "cut").alias("frame"), (F.col("rank") == F.col("cut")).cast("double").alias("y"), *x), "imputation-fit")
                found = logit_frames(fits, x, [f"{i}/{k + 1}" for i in names for k in range(len(cuts))])
                betas = [(int(i), [drawn(*found[f"{i}/{k + 1}"], seed, step, at, int(i), k).tolist() for k in range(len(cuts))]) for i in names]
                table = spark.createDataFrame(betas, "imputation int, _betas array<array<double>>")
                joined = made.join(F.broadcast(table), "imputation")
                # one uniform number serves all levels: what is left of it after a level is uniform again
                value, before = F.lit(levels[c][-1]), F.lit(1.0)
                steps = []
                for k in range(len(cuts)):
                    joined = joined.withColumn("_b", F.get(F.col("_betas"), F.lit(k)))
                    chance = 1 / (1 + F.exp(-F.least(F.lit(MAX_LOGIT), F.greatest(F.lit(-MAX_LOGIT), _eta("_b", x)))))
                    joined = joined.withColumn(f"_p{k}", chance)
                    steps.append((levels[c][k], before, F.col(f"_p{k}")))
                    before = before * (1 - F.col(f"_p{k}"))
                for v, left, chance in reversed(steps):
                    value = F.when(u < 1 - left * (1 - chance), v).otherwise(value)
            else:
                fits = seen.select(frame.alias("frame"), F.col(c).alias("y"), *x)
                betas = []
                for i, (b, inv, rss, n) in linear_frames(fits, x, names).items():
                    free = max(1, n - len(b))
                    sigma = math.sqrt(rss / np.random.default_rng([seed, step, at, int(i), 1]).chisquare(free))
                    betas.append((int(i), drawn(b, inv * sigma**2, seed, step, at, int(i)).tolist(), sigma))
                table = spark.createDataFrame(betas, "imputation int, _betas array<double>, _sigma double")
                joined = made.join(F.broadcast(table), "imputation")
                value = _eta("_betas", x) + F.col("_sigma") * normal_quantile(u)
            data = written(joined.withColumn(c, F.when(F.col(missing[c]), value).otherwise(F.col(c))).select(*data.columns), "imputation-step")
    return data.drop(*missing.values())


def rubin(estimates: list[float], errors: list[float]) -> dict:
    """Rubin's rules: estimate, se, within and between variance, degrees of freedom, share of information that is missing."""
    q, u = np.array(estimates, float), np.array(errors, float) ** 2
    m = len(q)
    within, between = float(u.mean()), float(q.var(ddof=1)) if m > 1 else 0.0
    total = within + (1 + 1 / m) * between
    extra = (1 + 1 / m) * between
    free = (m - 1) * (1 + within / extra) ** 2 if extra > 0 else math.inf
    return {"estimate": float(q.mean()), "se": math.sqrt(total), "within": within, "between": between, "df": free, "missing": extra / total if total > 0 else 0.0}


def pooled_effect(imputed: DataFrame, exposure: str, covariates: list[str], cluster: str = "incident_id", y: str = "outcome") -> dict:
    """The adjusted exchangeable effect of the exposure in each imputation, pooled; imputations without an estimate are left
    out and counted."""
    from mentionlab.operators import frames

    found = frames.effects(imputed, exposure, covariates, by="imputation", cluster=cluster, y=y).collect()
    own = [(r.log_or, r.se) for r in found if r.se is not None]
    if not own:
        return {"estimate": None, "se": None, "imputations": 0, "failed": len(found)}
    return rubin([b for b, _ in own], [s for _, s in own]) | {"imputations": len(own), "failed": len(found) - len(own)}
