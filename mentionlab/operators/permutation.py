"""The cluster permutation test of the pooled difference for frames of any size, many at once.

All that the statistic depends on are strata: incidents with equal k and n, how many there are and how many are exposed.
Where the distribution is small it is exact: strata are convolved one by one, and states with equal sums merge. Else
replicates are drawn: how many exposed incidents fall into each block of strata is a multivariate hypergeometric vector,
and so is what a block deals to its strata; a task draws one block for a slice of the replicates, and sums meet by
replicate. Nothing but a row for each frame reaches the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.session import written

SEED, TIMES = 20260101, 20_000
#: States of the exact distribution at most, and rows that one step may make; strata of a frame that is tried.
EXACT_STATES, EXACT_STEP, EXACT_STRATA = 200_000, 4_000_000, 2_000
#: Strata of one block, blocks of one frame at most, replicates of one slice.
BLOCK_STRATA, MAX_BLOCKS, SLICE = 4_000, 1_000, 2_000
#: Frames at once, at most.
MAX_FRAMES = 10_000
_NEAR = 1e-12


def exact_of(k: np.ndarray, n: np.ndarray, size: np.ndarray, hot: np.ndarray, states: int = EXACT_STATES, step: int = EXACT_STEP) -> float | None:
    """P(|difference| >= that seen) over all ways to deal the exposed, or None where there are too many states. What is held
    is bounded by `step` rows, and looked at before it is made."""
    m, total = int(hot.sum()), int(size.sum())
    whole_k, whole_n = int(k @ size), int(n @ size)
    order = np.argsort(size, kind="stable")
    dealt, sum_k, sum_n, weight = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)
    left = total
    for s in order:
        c = int(size[s])
        left -= c
        most = min(c, m)
        if len(dealt) * (most + 1) > step:
            return None
        j = np.arange(most + 1)
        ways = np.concatenate(([0.0], np.cumsum(np.log((c - j[1:] + 1) / j[1:]))))
        d = (dealt[:, None] + j).ravel()
        fits = (d <= m) & (m - d <= left)
        d, a, b, w = d[fits], (sum_k[:, None] + j * k[s]).ravel()[fits], (sum_n[:, None] + j * n[s]).ravel()[fits], (weight[:, None] + ways).ravel()[fits]
        key = np.lexsort((b, a, d))
        d, a, b, w = d[key], a[key], b[key], w[key]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0))))
        if len(first) > states:
            return None
        top = np.maximum.reduceat(w, first)
        weight = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(first, len(w))))), first))
        dealt, sum_k, sum_n = d[first], a[first], b[first]
    chance = np.exp(weight - weight.max())
    seen = abs(_difference(np.array([k @ hot]), np.array([n @ hot]), whole_k, whole_n)[0])
    return float(chance[np.abs(_difference(sum_k, sum_n, whole_k, whole_n)) >= seen - _NEAR].sum() / chance.sum())


def _difference(k1, n1, k, n):
    return k1 / n1 - (k - k1) / (n - n1)


def _exact(states: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        p = exact_of(*(part[c].to_numpy(np.int64) for c in ("k", "n", "size", "hot")), states)
        return pd.DataFrame({"frame": [key[0]], "p": [p]})

    return run


def _drawn(facts: dict[str, tuple[int, list[int]]], seed: int):
    """Exposed sums of each replicate of a slice in one block: facts has each frame's exposed incidents and block sizes."""

    def run(batches):
        for part in batches:
            for frame, block, slice_, times, ks, ns, sizes in zip(*(part[c] for c in ("frame", "block", "slice", "times", "ks", "ns", "sizes")), strict=True):
                m, blocks = facts[frame]
                name = zlib.crc32(frame.encode())
                left = np.random.default_rng([seed, name, slice_]).multivariate_hypergeometric(blocks, m, size=times, method="marginals")[:, block]
                rng = np.random.default_rng([seed, name, slice_, block + 1])
                rest, k1, n1 = int(sum(sizes)), np.zeros(times, np.int64), np.zeros(times, np.int64)
                for k, n, c in zip(ks, ns, sizes, strict=True):
                    rest -= int(c)
                    x = rng.hypergeometric(int(c), rest, left) if rest else left
                    k1 += x * int(k)
                    n1 += x * int(n)
                    left = left - x
                yield pd.DataFrame({"frame": frame, "rep": slice_ * SLICE + np.arange(times), "k1": k1, "n1": n1})

    return run


def permutation_frames(incidents: DataFrame, by: str = "frame", times: int = TIMES, seed: int = SEED, exact_up_to: int = EXACT_STATES, count: str | None = None) -> DataFrame:
    """incidents(frame, k, n, exposed), each row standing for `count` incidents where that is given: frame, incidents, observed, p, exact. Exposure is dealt anew over a frame's incidents,
    the statistic is the pooled difference, two-sided; drawn replicates count with the observed one. A frame with one arm
    has nulls. Incidents of a null k or n take no part; a frame has less than 10^9 incidents."""
    spark = incidents.sparkSession
    times_each = F.lit(1) if count is None else F.col(count)
    strata = incidents.where("k IS NOT NULL AND n IS NOT NULL").groupBy(F.col(by).cast("string").alias("frame"), F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))
    strata = written(strata.agg(F.sum(times_each).cast("long").alias("size"), F.sum(F.when(F.col("exposed") == 1, times_each).otherwise(0)).cast("long").alias("hot")), "permutation-strata")
    sums = [F.sum(F.col(c) * F.col(s)).alias(f"{c}_{s}") for c in "kn" for s in ("size", "hot")]
    facts = strata.groupBy("frame").agg(F.count(F.lit(1)).alias("strata"), F.sum("size").alias("size"), F.sum("hot").alias("hot"), *sums).limit(MAX_FRAMES + 1).collect()
    if len(facts) > MAX_FRAMES:
        raise ValueError(f"more than {MAX_FRAMES} frames")
    seen = {r.frame: _difference(r.k_hot, r.n_hot, r.k_size, r.n_size) for r in facts if r.n_hot and r.n_size > r.n_hot}
    found: dict[str, tuple[float, bool]] = {}
    tried = [r.frame for r in facts if r.frame in seen and r.strata <= EXACT_STRATA]
    if tried:
        exact = strata.where(F.col("frame").isin(tried)).groupBy("frame").applyInPandas(_exact(exact_up_to), "frame string, p double").collect()
        found = {r.frame: (r.p, True) for r in exact if r.p is not None}
    rest = [r for r in facts if r.frame in seen and r.frame not in found]
    if rest:
        found |= {f: ((1 + x) / (1 + times), False) for f, x in _sampled(strata, rest, seen, times, seed).items()}
    out = [(r.frame, r.size, seen.get(r.frame), *found.get(r.frame, (None, None))) for r in sorted(facts, key=lambda r: r.frame or "")]
    return spark.createDataFrame(out, "frame string, incidents long, observed double, p double, exact boolean")


def _sampled(strata: DataFrame, rest: list, seen: dict[str, float], times: int, seed: int) -> dict[str, int]:
    spark = strata.sparkSession
    table = spark.createDataFrame([(r.frame, min(MAX_BLOCKS, -(-r.strata // BLOCK_STRATA)), r.k_size, r.n_size, abs(seen[r.frame])) for r in rest], "frame string, blocks int, whole_k long, whole_n long, seen double")
    placed = strata.join(F.broadcast(table.select("frame", "blocks")), "frame").withColumn("block", F.pmod(F.xxhash64("k", "n"), F.col("blocks")).cast("int"))
    packed = placed.groupBy("frame", "block").agg(F.sum("size").alias("all"), F.array_sort(F.collect_list(F.struct("k", "n", "size"))).alias("s"))
    packed = written(packed.select("frame", "block", "all", *[F.col(f"s.{c}").alias(n) for c, n in (("k", "ks"), ("n", "ns"), ("size", "sizes"))]), "permutation-blocks")
    order: dict[str, list[tuple[int, int]]] = {}
    for r in packed.select("frame", "block", "all").collect():  # MAX_BLOCKS rows a frame at most
        order.setdefault(r.frame, []).append((r.block, r["all"]))
    numbers = [(f, b, i) for f, blocks in order.items() for i, (b, _) in enumerate(sorted(blocks))]
    facts = {r.frame: (r.hot, [n for _, n in sorted(order[r.frame])]) for r in rest}
    slices = F.explode(F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(min(SLICE, times - i * SLICE)).alias("times")) for i in range(-(-times // SLICE))]))
    work = packed.join(F.broadcast(spark.createDataFrame(numbers, "frame string, block int, at int")), ["frame", "block"])
    work = work.select("frame", F.col("at").alias("block"), "ks", "ns", "sizes", slices.alias("part")).select("frame", "block", "part.*", "ks", "ns", "sizes")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = work.repartition(tasks, "frame", "block", "slice").mapInPandas(_drawn(facts, seed), "frame string, rep long, k1 long, n1 long")
    each = drawn.groupBy("frame", "rep").agg(F.sum("k1").alias("k1"), F.sum("n1").alias("n1")).join(F.broadcast(table), "frame")
    diff = F.col("k1") / F.col("n1") - (F.col("whole_k") - F.col("k1")) / (F.col("whole_n") - F.col("n1"))
    return {r.frame: r.x for r in each.groupBy("frame").agg(F.count_if(F.abs(diff) >= F.col("seen") - _NEAR).alias("x")).collect()}
