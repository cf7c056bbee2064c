"""Permutation tests against enumeration, and on frames that no driver holds."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from mentionlab.operators import inference, permutation, suite


def plain(rows):
    """P by going through all ways to deal the exposure."""
    k, n = [r[0] for r in rows], [r[1] for r in rows]
    hot = [i for i, r in enumerate(rows) if r[2]]
    stat = lambda s: sum(k[i] for i in s) / sum(n[i] for i in s) - (sum(k) - sum(k[i] for i in s)) / (sum(n) - sum(n[i] for i in s))
    seen = stat(hot)
    every = [abs(stat(s)) >= abs(seen) - 1e-12 for s in itertools.combinations(range(len(rows)), len(hot))]
    return seen, sum(every) / len(every)


def frames(spark, named):
    return spark.createDataFrame([(f, *r) for f, rows in named.items() for r in rows], "frame string, k int, n int, exposed int")


def test_exact_for_many_frames_at_once(spark):
    named = {}
    for seed in range(6):
        rnd = random.Random(seed)
        named[f"f{seed}"] = [(rnd.randrange(n + 1), n, int(i < 3 + seed % 3)) for i, n in enumerate(rnd.choices((2, 3, 5), k=14))]
    named["one arm"] = [(1, 2, 0), (0, 3, 0)]
    got = {r.frame: r for r in permutation.permutation_frames(frames(spark, named)).collect()}
    for f, rows in named.items():
        if f != "one arm":
            assert (got[f].observed, got[f].p) == pytest.approx(plain(rows), abs=1e-9) and got[f].exact
    assert (got["one arm"].p, got["one arm"].observed, got["one arm"].incidents) == (None, None, 2)
    assert permutation.permutation_frames(frames(spark, {"x": [(1, 1, 1)]}).limit(0)).count() == 0


def test_drawn_replicates_agree_with_the_exact_distribution(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.randrange(n + 1), n, int(i < 7)) for i, n in enumerate(rnd.choices(range(2, 40), k=16))]
    df = frames(spark, {"a": rows, "b": rows[::-1]})
    monkeypatch.setattr(permutation, "BLOCK_STRATA", 5)  # several blocks
    seen, p = plain(rows)
    drawn = permutation.permutation_frames(df, times=5000, exact_up_to=1).collect()
    assert [r.exact for r in drawn] == [False, False]
    for r in drawn:
        assert abs(r.p - p) < 5 * math.sqrt(p * (1 - p) / 5000) and r.observed == pytest.approx(seen)
    again = permutation.permutation_frames(df.repartition(5), times=5000, exact_up_to=1).collect()
    assert [r.p for r in again] == [r.p for r in drawn]


def test_ten_million_incidents(spark):
    """Three large strata once took all memory; here are thousands, with 10^7 incidents."""
    i = F.col("id")
    kinds = spark.range(40_000).select(F.lit("all").alias("frame"), (i % 60).alias("k"), (i % 60 + i % 97).alias("n"), (i % 2).alias("exposed"), F.when(i % 2 == 1, 20).otherwise(480).alias("c"))
    r = permutation.permutation_frames(kinds, times=400, count="c").first()
    assert r.incidents == 10_000_000 and not r.exact and 1 / 401 <= r.p <= 1
    few = spark.createDataFrame([("x", 1, 2, 0, 3_000), ("x", 1, 3, 1, 63_000), ("x", 1, 3, 0, 127_000), ("x", 2, 4, 0, 190_000)], "frame string, k int, n int, exposed int, c int")
    assert permutation.permutation_frames(few, times=200, count="c").first().incidents == 383_000


def test_by_strata_and_sweep(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(4), 4, int(i % 4 == 0), 1 + i % 3) for i in range(15)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "incident_id int, k int, n int, exposed int, outlets int")
    seen, p = plain([r[:3] for r in rows])
    r = inference.permutation_by_strata(df)
    assert (r["observed"], r["p"], r["exact"]) == (pytest.approx(seen), pytest.approx(p), True)
    swept = {r.min_outlets: r for r in suite.sweep_with_tests(spark, df, (1, 2, 7)).collect()}
    assert swept[1].p == pytest.approx(p) and swept[2].p == pytest.approx(plain([r[:3] for r in rows if r[3] >= 2])[1])
    assert (swept[7].p, swept[7].n1, swept[7].diff) == (None, 0, None)
