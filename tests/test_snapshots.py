import datetime as dt

import pytest
from pyspark.sql import functions as F

from mentionlab.sources import snapshots

DAY = lambda k: dt.datetime(2025, 1, k, tzinfo=dt.timezone.utc)


def test_versions_are_whole_and_kept(spark, tmp_path):
    folder = str(tmp_path / "articles")
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, folder)
    articles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "article_id long, headline string")
    assert snapshots.write_snapshot(articles, folder, DAY(1)) == 1
    coded = spark.createDataFrame([(1, 1, None), (2, 0, "absent"), (9, 1, "headline")], "article_id long, names_index int, position string")
    assert snapshots.update_outcomes(spark, folder, coded, at=DAY(2)) == 2
    again = spark.createDataFrame([(2, 1, "headline")], "article_id long, names_index int, position string")
    assert snapshots.update_outcomes(spark, folder, again, at=DAY(3)) == 3
    rows = {r.article_id: (r.headline, r.names_index, r.position, r.coded_at is not None) for r in snapshots.read_snapshot(spark, folder).collect()}
    assert rows == {1: ("a", 1, None, True), 2: ("b", 1, "headline", True), 3: ("c", None, None, False)}
    old = {r.article_id: r.names_index for r in snapshots.read_snapshot(spark, folder, DAY(2)).collect()}
    assert old == {1: 1, 2: 0, 3: None}
    assert snapshots.read_snapshot(spark, folder, DAY(1)).columns == ["article_id", "headline"]


def test_a_failed_write_leaves_no_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(Exception, match="no good"):
        snapshots.write_snapshot(spark.range(3).select(F.raise_error(F.lit("no good")).cast("string").alias("x")), folder)
    assert snapshots.versions(spark, folder) == []
    snapshots.write_snapshot(spark.range(3), folder)
    (tmp_path / "t" / "_claim-2").write_text("")  # another writer is at work
    with pytest.raises(RuntimeError):
        snapshots.write_snapshot(spark.range(4), folder)
    assert snapshots.read_snapshot(spark, folder).count() == 3
