"""The analysis view, covariates, closed-form models and verdicts against plain formulas."""

import math

import pytest
from pyspark.sql import functions as F

from mentionlab.operators import agreement, covariates, inference, models, population, suite
from tests.test_study import dense_gee


def test_view_keeps_what_counts(spark):
    a = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 1, 1), (3, 1, 0, 0), (4, 2, 0, 1), (5, 3, 0, 1), (6, 4, None, 1), (7, 4, 0, 1)], "article_id long, incident_id long, excluded int, substantive int")
    i = spark.createDataFrame([(1, 1, 0, "2025-01-02", "T"), (2, 0, 0, "2025-01-02", "T"), (3, 1, 1, "2025-01-02", "T"), (4, 1, 0, "2024-05-05", None)], "incident_id long, eligible int, is_seed int, day string, entity string")
    got = {r.article_id: (r.year, r.exposed) for r in population.analysis_view(a, i, "T").collect()}
    assert got == {1: (2025, 1), 7: (2024, 0)}
    assert [r.incident_id for r in population.in_window(i, "day", "2024-05-05", "2024-12-31").collect()] == [4]


def test_covariates(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (99,), (100,), (None,)], "d int")
    assert [r[0] for r in df.select(covariates.deaths_bin(F.col("d"))).collect()] == ["nan", "0", "1", "2+", "2+", "nan", "nan"]
    v = spark.createDataFrame([(2023, 0, "a", None), (2025, 1, "b", 1), (2025, 2, None, 0)], "year int, deaths int, entity string, flag int")
    got = covariates.prepare(v, {"a": "x"}, ("kind",), ("flag", "absent")).collect()
    assert [round(r.year_c, 6) for r in got] == [-1.333333, 0.666667, 0.666667]
    assert [(r.entity_group, r.kind, r.flag) for r in got] == [("x", "unknown", 0), (covariates.DEFAULT_GROUP, "unknown", 1), (covariates.DEFAULT_GROUP, "unknown", 0)]


def test_first_values_skip_nulls(spark):
    rows = [(1, 1, None, "g"), (1, 2, 5, "g"), (1, 3, 7, "g"), (2, 1, None, "h")]
    df = spark.createDataFrame(rows, "incident_id long, article_id long, deaths int, grp string").withColumn("outcome", F.lit(1))
    assert {r.incident_id: r.deaths for r in covariates.first_values(df, ("deaths",), "article_id").collect()} == {1: 5, 2: None}
    t = {r.grp: r for r in covariates.table_one(df, "grp", "article_id", ("deaths",), outcomes=("outcome",)).collect()}
    assert (t["g"].incidents, t["g"].articles, t["g"].articles_per_incident, t["g"].deaths_mean, t["g"].outcome_pct) == (1, 3, 3.0, 5.0, 100.0)


def test_closed_form_is_the_gee(spark):
    df = models.simulate(spark, 40, 80, seed=9).selectExpr("incident_id", "outcome", "exposed", "if(incident_id % 3 = 0, 'a', 'b') frame")
    got = {r.frame: r for r in suite.robust_odds(df).collect()}
    for f in ("a", "b"):
        rows = [(r.incident_id, float(r.outcome), float(r.exposed)) for r in df.where(F.col("frame") == f).collect()]
        beta, se, _ = dense_gee(rows, 2, exchangeable=False)
        assert (got[f].log_or, got[f].se) == pytest.approx((beta[1], se[1]), abs=1e-8)
        assert got[f].p == pytest.approx(math.erfc(abs(beta[1] / se[1]) / math.sqrt(2)), rel=1e-6)
        m = suite.adjusted(df.where(F.col("frame") == f), "outcome", "exposed", exchangeable=False)
        assert (m["odds_ratio"], m["p"]) == pytest.approx((got[f].odds_ratio, got[f].p), rel=1e-6)


def test_gates_and_empty_cells(spark):
    rows = [("none named", i, 0, i % 2) for i in range(50)] + [("small", i, i % 2, i % 3 == 0) for i in range(9)] + [("one arm", i, i % 2, 0) for i in range(50)] + [("fine", i, int(i % 3 == 0), i % 2) for i in range(60)]
    df = spark.createDataFrame([(f, i, o, int(x)) for f, i, o, x in rows], "frame string, incident_id long, outcome int, exposed int")
    got = {r.frame: r.log_or for r in suite.robust_odds(df, least_rows=40, least_exposed=5).collect()}
    assert got["none named"] is got["small"] is got["one arm"] is None and got["fine"] is not None


def test_adjusted_model_against_dense(spark):
    df = models.simulate(spark, 30, 70, seed=12).selectExpr("incident_id", "cast(outcome as double) outcome", "cast(exposed as double) exposed", "cast(child as double) child", "kind", "register")
    data, names = suite.design(df, ("child",), ("kind", "register"))
    assert names == ["child", "kind_0", "kind_1", "register_0"]
    rows = [(r.incident_id, r.outcome, r.exposed, *[r[n] for n in names]) for r in data.collect()]
    beta, se, alpha = dense_gee(rows, 6)
    got = suite.adjusted(df, "outcome", "exposed", ("child",), ("kind", "register"))
    assert got["odds_ratio"] == pytest.approx(math.exp(beta[1]), rel=1e-7) and got["alpha"] == pytest.approx(alpha, abs=1e-7)
    assert got["low"] == pytest.approx(math.exp(beta[1] - 1.959963985 * se[1]), rel=1e-7)


def test_holm_without_some(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04)], "frame string, p double")
    assert {r.frame: r.p_holm for r in inference.holm(df, "frame").collect()} == {"a": 0.02, "c": 0.04}


def test_threshold_sweep_with_tests(spark):
    rows = [(1, 1, 2, 1, 3), (2, 2, 2, 1, 2), (3, 0, 4, 0, 3), (4, 1, 3, 0, 2), (5, 0, 5, 0, 1)]
    df = spark.createDataFrame(rows, "incident_id long, k long, n long, exposed int, outlets int")
    got = {r.min_outlets: r for r in suite.sweep_with_tests(spark, df, (1, 2, 3, 9)).collect()}
    assert (got[1].k1, got[1].n1, got[1].k0, got[1].n0) == (3, 4, 1, 12)
    assert got[1].p == pytest.approx(inference.permutation_by_strata(df)["p"]) and got[9].p is None and got[9]["diff"] is None


def test_verdicts_fail_without_exposed_gold(spark):
    gold = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "id long, v string")
    v = agreement.verdicts(gold, gold, "id", ["v"], exposure="v")
    assert v.first().verdict == "pass" and v.first().threshold == 0.9
    fine = agreement.recall(gold, gold, "id", "v", F.col("v") == "a")
    none = agreement.recall(gold, gold, "id", "v", F.col("v") == "zz")
    assert agreement.passed(v, fine) and not agreement.passed(v, none)
    worse = gold.withColumn("v", F.when((F.col("id") % 2 == 0) & (F.col("id") < 10), "q").otherwise(F.col("v")))
    assert not agreement.passed(v, agreement.recall(gold, worse, "id", "v", F.col("v") == "a"))
    assert agreement.verdicts(gold, worse.where("id < 12"), "id", ["v"]).first().verdict == "FAIL"
    assert agreement.disagreements(gold, worse, "id", "v").count() == 5


def test_workflow_filters_are_null_safe(spark):
    i = spark.createDataFrame([(1, None, None), (2, "human_adjudication", "x [GOLD]"), (3, "model", "gold")], "incident_id long, coded_by string, notes string")
    ids = lambda df: sorted(r.incident_id for r in df.collect())
    assert ids(population.unadjudicated(i)) == [1, 3] and ids(population.gold(i)) == [2]
    assert ids(population.uncoded(i, i.where("incident_id = 1"))) == [2, 3]
    assert population.without(i.withColumn("Body_Names_Make", F.lit(1))).columns == i.columns
    wire = spark.createDataFrame([(1, 1, "S"), (2, 1, "S"), (3, 1, None), (4, 1, ""), (5, 2, "S")], "article_id long, incident_id long, syndication string")
    assert sorted(r.article_id for r in population.one_per_group(wire).collect()) == [1, 3, 4, 5]


def test_cluster_numbers(spark):
    df = spark.createDataFrame([(5, 2), (1, 2), (9, 7), (4, 1)], "cluster long, size long")
    assert {r.cluster: r.cluster_id for r in population.numbered_clusters(df).collect()} == {9: "C0001", 1: "C0002", 5: "C0003", 4: "C0004"}
    names = spark.createDataFrame([("x", "A", True), ("y", "B", True), ("z", "C", False)], "domain string, brand string, counts boolean")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "doc long, cluster long")
    m = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "doc long, domain string")
    assert [(r.cluster, r.n_brands, r.cluster_id) for r in population.candidate_clusters(c, m, names, 2).collect()] == [(1, 2, "C0001")]


def test_search_products():
    got = population.search_products(("a", "b c", "d"), ("x", "y"), (2, 1))
    assert got == ['(a OR "b c") (x)', '(a OR "b c") (y)', "(d) (x)", "(d) (y)"]
