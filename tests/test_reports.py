import pytest
from pyspark.sql import functions as F

from mentionlab.operators import coding
from mentionlab.operators import incidents as inc
from mentionlab.sources import harvest, sinks


def test_report_and_empty_arm(spark):
    rows = [(1, 1, 1, 1, "a|b", "1"), (1, 2, 0, 1, "a|b", "1"), (2, 1, 0, 0, "c", "1"), (2, 2, 0, 0, "c", "1")]
    df = spark.createDataFrame(rows, "incident_id long, outlet long, outcome int, exposed int, entity string, tier string")
    i = inc.to_incidents(df)
    text = sinks.two_arm_report(inc.compared(inc.arms(i)), inc.drop_reasons(df), inc.by_entity(i), {"p": 1.0, "exact": True})
    assert "1/2 = 50.0 %" in text and "a\\|b" in text and "(exact)" in text
    one = inc.to_incidents(df.where("exposed = 0"))
    assert "empty" in sinks.two_arm_report(inc.compared(inc.arms(one)), inc.drop_reasons(df), inc.by_entity(one), {})


def test_exports(spark, tmp_path):
    inc_ = spark.createDataFrame([("1", "x"), ("2", "y")], "incident_id string, note string")
    art = spark.createDataFrame([("1", "b"), ("1", "a")], "incident_id string, title string")
    sinks.write_json(sinks.review_json(inc_, art), str(tmp_path / "j"))
    back = {r.incident_id: r.articles for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert [a.title for a in back["1"]] == ["a", "b"] and back["2"] is None
    sinks.write_csv(inc_, str(tmp_path / "c"), files=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_classifier_failures_stay_null(spark):
    def fails_on_x(texts):
        if "x" in texts:
            raise RuntimeError("down")
        return [i for i, t in enumerate(texts) if t.startswith("crash")]

    df = spark.createDataFrame([(1, "crash a"), (2, "calm"), (3, None), (4, "x")], "id int, t string").coalesce(1)
    got = {r.id: r.relevant for r in coding.classify_batches(df, "t", fails_on_x, batch=1).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: None}


def test_answers(spark):
    df = spark.createDataFrame([('```json\n{"deaths": 2, "secret": 1}\n```',), ("no json",)], "x string").select(coding.parse_answer(F.col("x"), "deaths int").alias("p")).collect()
    assert df[0].p.deaths == 2 and (df[1].p is None or df[1].p.deaths is None)
    assert spark.range(1).select(coding.cut_words(F.lit("one two three"), 9)).first()[0] == "one two"
    assert [spark.range(1).select(coding.decision(F.lit(x), 25, 15, 8)).first()[0] for x in (30, 20, 9, 1)] == ["go", "go, limited", "widen", "stop"]


def test_windows_and_ledger(spark):
    span = spark.createDataFrame([("2025-01-01", "2025-01-20")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    w = harvest.fixed_windows(span, F.col("a"), F.col("b"), 7)
    assert [(str(r.start), str(r.end)) for r in w.orderBy("k").collect()] == [("2025-01-01", "2025-01-07"), ("2025-01-08", "2025-01-14"), ("2025-01-15", "2025-01-20")]
    ledger = spark.createDataFrame([(0, "ok"), (1, "failed")], "k int, status string")
    assert sorted(r.k for r in harvest.open_windows(w, ledger).collect()) == [1, 2]


@pytest.mark.parametrize("n", [1, 3])
def test_candidates(spark, n):
    c = spark.createDataFrame([(i, 0) for i in range(n)], "doc long, cluster long")
    m = spark.createDataFrame([(i, "t" * 200, f"u{i}", "o", "2025-01-01") for i in range(n)], "doc long, title string, url string, outlet string, day string")
    r = sinks.candidate_rows(c, m).first()
    assert r.n_articles == n and r.n_outlets == 1 and len(r.titles) == 120 * n + 4 * (n - 1)
