from mentionlab.streaming import daily


def test_ingest_keeps_first_of_each_key(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "url_hash string, source string"
    spark.createDataFrame([("a", "s2"), ("a", "s1"), ("b", "s1"), (None, "s1")], schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    daily.ingest(stream(), "url_hash", ["source"], out, check)
    spark.createDataFrame([("a", "s0"), ("c", "s1"), ("c", "s0")], schema).coalesce(1).write.mode("append").parquet(src)
    daily.ingest(stream(), "url_hash", ["source"], out, check)
    daily.ingest(stream(), "url_hash", ["source"], out, check)  # nothing new
    assert sorted((r.url_hash, r.source) for r in spark.read.parquet(out).collect()) == [("a", "s1"), ("b", "s1"), ("c", "s0")]


def test_ingest_reads_no_table_and_restarts_anywhere(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "url_hash string, source string, place int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    want = {}
    for batch in range(4):
        rows = [(f"k{(batch * 5 + i) % 12}", f"s{batch}", 10 - i) for i in range(9)] + [(f"k{batch}", None, 0)]
        for k, s, p in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2])):
            want.setdefault(k, (s, p))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        daily.ingest(stream(), "url_hash", ["source", "place"], out, check)  # each run is a restart from the checkpoint
    got = {r.url_hash: (r.source, r.place) for r in spark.read.parquet(out).collect()}
    assert got == want
    plan = daily.first_by_key(stream(), "url_hash", ["source"])
    assert out not in plan._jdf.queryExecution().logical().toString()


def test_window_ledger_retries_by_event_time(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "tag string, window string, status string, n_returned long, at timestamp"

    def put(*rows):
        import datetime as dt

        day = dt.datetime(2025, 1, 1)
        spark.createDataFrame([(t, w, s, n, day + dt.timedelta(minutes=m)) for t, w, s, n, m in rows], schema).coalesce(1).write.mode("append").parquet(src)
        ledger = daily.window_ledger(spark.readStream.schema(schema).parquet(src))
        ledger.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window, r.status, r.tries) for r in spark.read.parquet(out).collect())

    assert put(("a", "w1", "failed", None, 0), ("a", "w2", "ok", 3, 1), ("a", "w3", "absent", 0, 1)) == [("w1", "failed", 1), ("w2", "ok", 1 - 1), ("w3", "absent", 0)]
    assert ("w1", "retry", 1) in put(("a", "w4", "ok", 1, 300))  # the watermark passes the failure by more than the wait
    found = put(("a", "w1", "failed", None, 301), ("a", "w1", "failed", None, 302), ("a", "w1", "ok", 9, 303), ("a", "w2", "failed", None, 304))
    assert ("w1", "given up", 3) in found and ("w1", "ok", 3) not in found
    assert [f for f in found if f[0] == "w2"] == [("w2", "ok", 0)]
