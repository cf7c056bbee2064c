"""Row numbers over whole tables."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as registry
from mentionlab.operators import corrections, population, ranks


def test_places_are_those_of_one_sort(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") * 37 % 1000).alias("b"), F.lit(1).alias("_range"))
    got = ranks.numbered(df, "place", F.desc("a"), F.col("b"), ranges=6)
    want = sorted(((-r.a, r.b) for r in df.collect()))
    assert [(-r.a, r.b) for r in got.orderBy("place").collect()] == want
    assert got.columns == ["a", "b", "_range", "place"] and got.agg(F.min("place"), F.max("place")).first()[:] == (1, 1000)
    assert ranks.numbered(df.limit(0), "place", F.col("a")).count() == 0


def test_clusters_of_one_size_use_all_tasks(spark, monkeypatch):
    seen = []
    keep = ranks.written
    monkeypatch.setattr(ranks, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    df = spark.range(4000).select(F.col("id").alias("cluster"), F.lit(2).alias("size"))
    got = population.numbered_clusters(df)
    assert [r.cluster_id for r in got.orderBy("cluster").limit(2).collect()] == ["C0001", "C0002"]
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_numbers_of_a_day_go_on_beyond_ninety_nine(spark):
    new = spark.createDataFrame([(i, "2026-01-02") for i in range(3)], "k long, day string")
    old = spark.createDataFrame([("20260102-07",), ("20260102-150",)], "incident_id string")
    got = {r.k: r.incident_id for r in corrections.next_ids(new, old, "day", "k").collect()}
    assert got == {0: "20260102-151", 1: "20260102-152", 2: "20260102-153"}
    first = corrections.next_ids(new, old.limit(0), "day", "k").collect()
    assert sorted(r.incident_id for r in first) == ["20260102-01", "20260102-02", "20260102-03"]


def test_ids_of_crowded_days_agree_with_the_sql(spark, tmp_path):
    n = 700  # more than a hundred old and new orders of a day
    spark.range(n).selectExpr("id AS o_orderkey", "CAST('1995-03-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(id % 2 AS INT)) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    df = registry.queries()["next_sequence_ids"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(registry.oracle_sql()["next_sequence_ids"]).fetchall())
