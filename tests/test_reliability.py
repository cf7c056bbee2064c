import math
import random

import pytest
from pyspark.sql import functions as F

from mentionlab.operators import reliability as rel


def plain(pairs, quadratic):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    d = (lambda x, y: (x - y) ** 2) if quadratic else (lambda x, y: abs(x - y))
    n = len(pairs)
    seen = sum(d(x, y) for x, y in pairs)
    chance = sum(d(x, y) for x, _ in pairs for _, y in pairs) / n
    return n, None if not chance else 1 - seen / chance


@pytest.mark.parametrize("quadratic", [True, False])
def test_weighted_kappa(spark, quadratic):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([0, 1, 2, 4, None]), rnd.choice([0, 1, 2, 4, 7, None])) for g in "ab" for _ in range(60)] + [("c", 2, 2), ("c", 2, 2)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {r.g: (r.n, r.weighted_kappa) for r in rel.weighted_kappa(df, "x", "y", "g", quadratic=quadratic).collect()}
    for g in "abc":
        n, k = plain([r[1:] for r in rows if r[0] == g], quadratic)
        assert got[g] == (n, None if k is None else pytest.approx(k))
    whole = rel.weighted_kappa(df, "x", "y", quadratic=quadratic).first()
    assert (whole.n, whole.weighted_kappa) == (pytest.approx(plain([r[1:] for r in rows], quadratic)[0]), pytest.approx(plain([r[1:] for r in rows], quadratic)[1]))


def test_places(spark):
    df = spark.createDataFrame([("headline",), ("absent",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(rel.place_of(F.col("p"))).collect()] == [0, 4, None, None]


def test_samples_have_their_exact_size_and_stay(spark):
    df = spark.range(1003).select(F.col("id"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").alias("s"), F.lit(1).alias("_place"))
    got = rel.sampled_share(df, "id", 0.2, by="s")
    assert got.columns == df.columns
    ids = {r.id for r in got.collect()}
    assert {s: sum(1 for i in ids if lo <= i < hi) for s, lo, hi in (("hot", 0, 900), ("b", 900, 990), ("none", 990, 1003))} == {"hot": 180, "b": 18, "none": math.ceil(13 * 0.2)}
    assert {r.id for r in rel.sampled_share(df.repartition(7), "id", 0.2, by="s").collect()} == ids
    assert rel.sampled_share(df, "id", 0.15).count() == math.ceil(1003 * 0.15) and rel.sampled_share(df.limit(0), "id", 0.5).count() == 0


def test_outcome_check_and_credits(spark):
    h = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, y long")
    m = h.withColumn("y", F.when(F.col("id") < 3, 5).otherwise(F.col("y")))
    assert rel.outcome_check(h, m, "id", "y").first()[:] == (100, 3, 0.03, "revise")
    assert rel.outcome_check(h, m.where("id > 0"), "id", "y").first().verdict == "revise" and rel.outcome_check(h, h, "id", "y").first().verdict == "keep"
    assert rel.outcome_check(h, m.limit(0), "id", "y").first()[:] == (0, 0, None, "no data")
    texts = {"By AAP\nA crash.": True, "A crash.\n\n(Australian Associated Press) \n": True, "One\nAAP in the middle\nend": False, "AAPT has news": False, "aap": False, None: False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(rel.agency_credit(F.col("t"))).collect()] == list(texts.values())
