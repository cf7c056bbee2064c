"""Clusters that are alike are counted once, and models of them are those of all clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.operators import frames, glmm, kinds

ROWS = [(1, 0.0, 2.0, 1.0), (1, 1.0, 1.0, 1.0), (2, 1.0, 2.0, 1.0), (2, 0.0, 1.0, 1.0), (3, None, 2.0, 0.0)]


def test_one_of_each_kind(spark):
    one = spark.createDataFrame(ROWS, "c long, x1 double, n double, k double")
    many = one.crossJoin(spark.range(50).withColumnRenamed("id", "i")).select((F.col("c") + 10 * F.col("i")).alias("c"), "x1", "n", "k").repartition(5)
    got = kinds.one_of_each(many, [], ["x1"])
    assert got.count() == 5 and {r.w for r in got.collect()} == {50.0}
    assert sorted((r.c, r.x1, r.n, r.k) for r in got.drop("w").collect() if r.c < 3) == sorted(r for r in ROWS if r[0] < 3)
    null = one.withColumn("c", F.when(F.col("c") > 1, F.col("c")))
    assert sorted((r.w for r in kinds.one_of_each(null, [], ["x1"]).collect())) == [1.0] * 5


def test_places_of_nulls_and_sets_tell_kinds_apart(spark):
    rows = [("f", 1, None, 1.0, 1.0, 0.0), ("f", 2, 1.0, None, 1.0, 0.0), ("f", 3, 0.0, 1.0, 1.0, 0.0), ("g", 4, 0.0, 1.0, 1.0, 0.0), ("f", 5, 0.0, 1.0, 1.0, 1.0)]
    got = kinds.one_of_each(spark.createDataFrame(rows, "frame string, c long, x1 double, x2 double, n double, k double"), ["frame"], ["x1", "x2"])
    assert {r.c: r.w for r in got.collect()} == dict.fromkeys(range(1, 6), 1.0)


@pytest.fixture(scope="module")
def clusters(spark):
    """Sixty clusters, and each of them nine times."""
    one = spark.range(60).select(F.col("id").alias("incident_id"), (F.col("id") % 3 == 0).cast("int").alias("exposed"), F.explode(F.sequence(F.lit(0), F.col("id") % 5)).alias("i"))
    one = one.withColumn("outcome", (F.pmod(F.xxhash64("incident_id", "i"), F.lit(10)) < 3 + F.col("exposed") + 2 * (F.col("incident_id") % 4 == 1).cast("int")).cast("int")).drop("i")
    return one, one.crossJoin(spark.range(9).withColumnRenamed("id", "i")).select((F.col("incident_id") + 100 * F.col("i")).alias("incident_id"), "exposed", "outcome").repartition(4)


def test_rounds_of_the_random_intercept_hold_kinds(spark, clusters, monkeypatch):
    seen = []
    real = glmm.written
    monkeypatch.setattr(glmm, "written", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    one, nine = (glmm.random_intercept(rows, ["exposed"]) for rows in clusters)
    assert max(df.count() for name, df in seen if name == "glmm-clusters") < 60
    assert nine["beta"]["exposed"] == pytest.approx(one["beta"]["exposed"], abs=1e-5) and nine["sigma"] == pytest.approx(one["sigma"], abs=1e-4)
    assert nine["loglik"] == pytest.approx(9 * one["loglik"], rel=1e-7) and nine["clusters"] == 540
    assert nine["se"]["exposed"] == pytest.approx(one["se"]["exposed"] / 3, rel=1e-4)


def test_rounds_of_frames_hold_kinds(spark, clusters, monkeypatch):
    seen = []
    real = frames.written
    monkeypatch.setattr(frames, "written", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    one, nine = (frames.effects(rows.withColumn("frame", F.lit("f")), "exposed").first() for rows in clusters)
    assert max(df.count() for name, df in seen if name == "gee-frames") < 60
    assert (nine.n, nine.clusters, nine.exposed_clusters) == (9 * one.n, 540, 180)
    assert nine.log_or == pytest.approx(one.log_or, abs=0.02) and nine.se == pytest.approx(one.se / 3, rel=0.02)


def test_bootstrap_holds_kinds_and_large_counts(spark, clusters, monkeypatch):
    seen = {}
    real = frames.written
    monkeypatch.setattr(frames, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    got = frames.bootstrap_adjusted(clusters[1], "exposed", [], times=20)
    assert got["failed"] == 0 and seen["bootstrap-weighted"].count() < 60
    sums = [sum(col) for col in zip(*[frames._unpacked(r.w, 20).tolist() for r in seen["bootstrap-weighted"].collect()], strict=True)]
    assert sums == [540] * 20
    for most in (255, 256, 70_000, 1 << 33):
        assert frames._unpacked(frames._packed(np.array([0, most])), 2).tolist() == [0, most]
