"""Shuffles and files whose tasks are bounded by rows."""

import os

import pytest

import __spark_entry__ as registry
from mentionlab import session
from mentionlab.plans import landing, view
from mentionlab.session import table
from mentionlab.sources import landed


def test_tasks_grow_with_rows(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.parts(spark.range(50)) == least and session.parts(spark.range(10_001)) == 101


@pytest.mark.parametrize(("name", "source"), [("outlet_report", "lineitem"), ("split_incidents", "orders")])
def test_queries_are_laid_out_by_rows(spark, sf_dir, monkeypatch, name, source):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    n = -(-table(spark, sf_dir, source).count() // 100)
    df = registry.queries()[name](spark, sf_dir)
    assert f", {n}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_the_models_frame_is_written_once_in_tasks_of_few_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    seen = []
    real = view.written
    monkeypatch.setattr(view, "written", lambda df, name: seen.append(df) or real(df, name))
    rows = view.frame(spark, sf_dir)
    n = -(-table(spark, sf_dir, "lineitem").count() // 100)
    assert len(seen) == 1 and f", {n}), REPARTITION_BY_NUM" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows.columns) == sorted(view.FRAME) and rows.count() == seen[0].count()


def test_review_files_are_many(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(landing, "REVIEWED", 50)
    paths = []
    real = landed.decisions
    monkeypatch.setattr(landed, "decisions", lambda s, path: paths.append(path) or real(s, path))
    landing.review_files(spark, sf_dir).count()
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    files = [f for f in os.listdir(paths[0]) if f.startswith("part-") and os.path.getsize(os.path.join(paths[0], f))]
    assert len(files) >= 0.9 * o.count() // 50 and real(spark, paths[0]).count() == o.count()
