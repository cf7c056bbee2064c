import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import coding, lexicon
from mentionlab.sources import landed, sinks


def put(folder, address, content):
    (folder / hashlib.sha1(address.encode()).hexdigest()).write_bytes(content)


def test_zone_tells_gzip_by_its_first_bytes(spark, tmp_path):
    put(tmp_path, "a.gz", b"plain \xff text")
    put(tmp_path, "b.xml", gzip.compress("zipped é".encode()))
    got = {r.key: r.text for r in landed.texts(spark, str(tmp_path)).collect()}
    assert got == {hashlib.sha1(b"a.gz").hexdigest(): "plain � text", hashlib.sha1(b"b.xml").hexdigest(): "zipped é"}
    sha = {r.file: r.sha for r in landed.frozen(spark, str(tmp_path)).collect()}
    assert sha[hashlib.sha1(b"a.gz").hexdigest()] == hashlib.sha256(b"plain \xff text").hexdigest()[:16]


def test_daily_harvest_resumes(spark, tmp_path):
    site = landed.Site("a.example", "daily", "https://a.example/s{}.xml", "trailing")
    put(tmp_path, "https://a.example/s250101.xml", b"<url><loc>https://a.example/car-crash-in-town</loc></url><url><loc>https://a.example/nothing-to-see</loc></url><url><loc>https://x.example/car-crash-far-away</loc></url>")
    put(tmp_path, "https://a.example/s250103.xml", gzip.compress(b"<url><loc>https://a.example/car-crash-in-town?utm_x=1</loc><lastmod>2025-01-02T09:00</lastmod></url>"))
    outlets = spark.createDataFrame([("a.example", "A", 0)], "domain string, brand string, place int")
    files = landed.texts(spark, str(tmp_path))
    plan = landed.plan(spark, site, "2025-01-01", "2025-01-04")
    rows, done = landed.harvest_site(site, landed.landed(plan, files), "2025-01-01", "2025-01-04", t.EVENT_TERMS, outlets)
    assert [(r.canonical_url, r.domain, r.title_at_crawl, r.seendate) for r in rows.collect()] == [("https://a.example/car-crash-in-town", "A", "[slug, not real headline] car crash in town", "2025-01-01")]
    assert {r.window: (r.n_returned, r.status) for r in done.collect()} == {"2025-01-01": (3, "ok"), "2025-01-02": (0, "absent"), "2025-01-03": (1, "ok"), "2025-01-04": (0, "absent")}
    assert landed.landed(plan, files, done).count() == 0
    assert landed.landed(plan, files, done.where("window < '2025-01-03'")).count() == 2


def test_kinds(spark):
    pages = landed.plan(spark, landed.Site("a", "paginated", "u{}", "dated", pages=3), "2025-01-01", "2025-01-02")
    assert [r.address for r in pages.orderBy("window").collect()] == ["u0", "u1", "u2"]
    months = landed.plan(spark, landed.Site("a", "monthly", "u{}", "dated"), "2024-12-31", "2025-02-01").orderBy("window").collect()
    assert [(r.address, str(r.default_day)) for r in months] == [("u2024-12", "2024-12-01"), ("u2025-01", "2025-01-01"), ("u2025-02", "2025-02-01")]
    for site in (landed.Site("a", "weekly", "u", "dated"), landed.Site("a", "index", "u", "dated")):
        with pytest.raises(ValueError):
            landed.plan(spark, site, "2025-01-01", "2025-01-02")


def test_capped_windows_are_cut(spark):
    plan = landed.search_plan(spark, [], ["q"], "2025-01-01", "2025-01-31")
    first = plan.orderBy("start").first()
    ledger = lambda rows: spark.createDataFrame([(first.query_hash, a, b, n, ok) for a, b, n, ok in rows], "query_hash string, start date, end date, n_returned int, ok boolean")
    spans = lambda df: sorted((str(r.start), str(r.end)) for r in df.collect())
    assert spans(landed.open_searches(plan, ledger([]))) == [("2025-01-01", "2025-01-30"), ("2025-01-31", "2025-01-31")]
    full = (first.start, first.end, 250, True)
    cut = landed.open_searches(plan, ledger([full]))
    assert spans(cut) == [("2025-01-01", "2025-01-15"), ("2025-01-16", "2025-01-30"), ("2025-01-31", "2025-01-31")]
    half = cut.orderBy("start").first()
    assert spans(landed.open_searches(plan, ledger([full, (half.start, half.end, 9, True)]))) == [("2025-01-16", "2025-01-30"), ("2025-01-31", "2025-01-31")]
    assert spans(landed.open_searches(plan, ledger([(first.start, first.end, 0, False)])))[0] == ("2025-01-01", "2025-01-30")


def test_windows_are_cut_until_none_is_capped(spark):
    plan = landed.search_plan(spark, [], ["q"], "2025-01-01", "2025-01-30")
    day = lambda k: f"2025-01-{k:02d}"
    ledger = spark.createDataFrame([(a, b, n) for a, b, n in [(1, 30, 250), (1, 15, 250), (16, 30, 250), (1, 8, 250), (9, 15, 3), (16, 23, 900), (1, 4, 250), (5, 8, 250), (1, 2, 250), (3, 4, 1), (1, 1, 250), (2, 2, 9)]], "a int, b int, n int")
    ledger = ledger.select(F.lit(plan.first().query_hash).alias("query_hash"), F.expr("date_add('2024-12-31', a)").alias("start"), F.expr("date_add('2024-12-31', b)").alias("end"), F.col("n").alias("n_returned"), F.lit(True).alias("ok"))
    got = sorted((str(r.start), str(r.end)) for r in landed.open_searches(plan, ledger).collect())
    assert got == [(day(5), day(6)), (day(7), day(8)), (day(16), day(19)), (day(20), day(23)), (day(24), day(30))]
    assert landed.open_searches(plan, ledger.withColumn("ok", F.lit(False))).count() == 1


def test_damaged_files_and_exhausted_tries_fail(spark, tmp_path):
    put(tmp_path, "u0", gzip.compress(b"<url><loc>x</loc></url>" * 50)[:40])
    put(tmp_path, "u1", b"\x1f\x8bno gzip")
    put(tmp_path, "u2", b"<url><loc>https://a/x</loc></url>")
    plan = landed.plan(spark, landed.Site("a", "paginated", "u{}", "dated", pages=5), "2025-01-01", "2025-01-02")
    tries = spark.createDataFrame([("u3", "exhausted"), ("u4", "absent"), ("u2", "exhausted")], "address string, outcome string")
    got = landed.landed_in(spark, str(tmp_path), plan, tries=tries)
    assert {r.window: r.status for r in got.collect()} == {"0": "failed", "1": "failed", "2": "ok", "3": "failed", "4": "absent"}
    outlets = spark.createDataFrame([("a", "A", 0)], "domain string, brand string, place int")
    _, done = landed.harvest_site(landed.Site("a", "paginated", "u{}", "dated", pages=5), got, "2025-01-01", "2025-01-02", t.EVENT_TERMS, outlets)
    assert {r.window: (r.n_returned, r.status) for r in done.collect()}["0"] == (0, "failed")
    assert sorted(r.window for r in landed.open_plan(plan, done).collect()) == ["0", "1", "3"]


def test_only_planned_files_are_opened(spark, tmp_path, monkeypatch):
    for k in range(30):
        put(tmp_path, f"u{k}", b"x" * (k + 1))
    monkeypatch.setattr(landed, "MAX_PATHS", 2)
    opened = []
    files = landed._files
    monkeypatch.setattr(landed, "_files", lambda s, p: opened.append(p) or files(s, p))
    plan = landed.plan(spark, landed.Site("a", "paginated", "u{}", "dated", pages=5), "2025-01-01", "2025-01-02")
    got = landed.texts(spark, str(tmp_path), landed.open_plan(plan).select("key"))
    assert sorted(len(r.text) for r in got.collect()) == [1, 2, 3, 4, 5]
    assert len(got.inputFiles()) == 5 and [len(p) for p in opened[1:]] == [2, 2, 1]
    assert landed.texts(spark, str(tmp_path), spark.createDataFrame([("0" * 40,)], "key string")).count() == 0


def test_review_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"incident_id": "1", "verdict": "accept", "make": "Kia"}, {"incident_id": "2", "decision": "reject", "reason": "no", "make": ""}]))
    got = {r.incident_id: (r.verdict, r.entity, r.why) for r in landed.decisions(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"1": ("accept", "Kia", None), "2": ("reject", None, "no")}
    (tmp_path / "f.json").write_text(json.dumps([{"article_id": "a"}, {"article_id": "a"}, {"x": 1}]))
    assert [r.article_id for r in landed.flags(spark, str(tmp_path / "f.json")).collect()] == ["a"]


def test_exports_for_review(spark):
    i = spark.createDataFrame([("1", "2025-02-01", "T", 1), ("2", "2025-02-02", None, 1), ("3", "2025-02-03", "x", 0)], "incident_id string, day string, entity string, eligible int")
    a = spark.createDataFrame([("1", "b", "o1", "CRASH AGAIN", None, "Crash again\nThe driver left.", 0), ("1", "a", "o2", "h", None, None, 0), ("2", "a", "o1", "h2", None, "x", 1)], "incident_id string, published string, outlet string, headline string, standfirst string, body string, excluded int")
    got = {r.incident_id: r for r in sinks.cluster_review(i, a, "T").collect()}
    assert set(got) == {"1", "2"} and got["2"].entity == "(not established)" and got["2"].n_outlets == 0 and got["2"].articles is None
    assert [x.published for x in got["1"].articles] == ["a", "b"] and got["1"].is_exposed
    blind = {r.incident_id: r.articles for r in sinks.blinded(i.where("eligible = 1"), a).collect()}
    assert [x.body for x in blind["1"]] == ["", "The driver left."] and blind["1"][0].asDict().keys() == {"outlet", "body"}


def test_reports(spark):
    from mentionlab.operators import agreement

    gold = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "id long, v string")
    v, r = agreement.verdicts(gold, gold, "id", ["v"]), agreement.recall(gold, gold, "id", "v", F.col("v") == "a")
    good = sinks.validation_report(v, r, 40)
    assert "**PASS**" in good and "within the limit" in good
    bad = sinks.validation_report(v, agreement.recall(gold, gold, "id", "v", F.lit(False)), 12)
    assert "**FAIL**" in bad and "too few" in bad and "cannot be told" in bad
    text = sinks.analysis_report({"One": gold.limit(2), "None": gold.limit(0)}, {"One": "note"})
    assert "## One\n\nnote" in text and "Not estimable." in text
    i = spark.createDataFrame([("1", "2025-02-01", "T"), ("2", "2025-02-02", ""), ("3", "2025-02-03", "T")], "incident_id string, day string, entity string")
    a = spark.createDataFrame([("1", "p2", "o", "second", 1), ("1", "p1", "o", "first", 0)], "incident_id string, published string, outlet string, headline string, named int")
    text = sinks.appendix_report(i, a)
    assert text.index("## T (2)") < text.index("## (not established) (1)") and text.index("first") < text.index("second (named)") and "* no article" in text


def test_samples_and_answers(spark):
    units = spark.createDataFrame([(i, int(i < 30)) for i in range(90)], "id long, hot int")
    sample = coding.gold_sample(units, "id", F.col("hot") == 1, size=28)
    assert sample.count() == 30 and sample.agg(F.min("hot")).first()[0] == 1
    small = coding.gold_sample(units.where("id >= 25"), "id", F.col("hot") == 1, size=28)
    assert small.count() == 28 and small.agg(F.sum("hot")).first()[0] == 5
    assert coding.drawn(units, "id").count() == 60 and coding.drawn(units, "id").collect() == coding.drawn(units, "id").collect()
    answers = spark.createDataFrame([(1, "fire", 1), (2, "odd", None)], "id int, kind string, headline_names_make int").withColumn("deaths", F.when(F.col("id") == 1, 2))
    got = {r.id: r for r in coding.validated(answers, ["kind", "deaths"], {"kind": ["fire", "collision"]}).collect()}
    assert "headline_names_make" not in got[1] and got[1].missing == [] and got[2].missing == ["kind", "deaths"]
    sizes = lambda theta: spark.createDataFrame([(1, 3), (2, 1)] if theta < 0.4 else [(1, 2), (2, 1), (3, 1)], "cluster long, size long")
    assert [tuple(r) for r in coding.sweep(sizes, (0.25, 0.45)).orderBy("theta").collect()] == [(0.25, 2, 1, 3), (0.45, 3, 1, 2)]


def test_vocabulary_must_be_neutral(spark):
    cars = lexicon.Lexicon((lexicon.Entity("Ford", "ice", ("Ford",)), lexicon.Entity("Kia", "", ("Kia",))))
    lexicon.assert_neutral(t.EVENT_TERMS, cars)
    with pytest.raises(ValueError):
        lexicon.assert_neutral(("hit by a ford",), cars)
    df = spark.createDataFrame([("Ford",), ("Kia",), (None,)], "e string")
    assert [r.entity_group for r in lexicon.with_group(df, "e", cars, "rest").collect()] == ["ice", "rest", "rest"]


def test_state_hint(spark):
    hints = {"new south": "NSW", "wa": "WA", "south": "SA"}
    df = spark.createDataFrame([("in New South Wales",), ("at the wall in wa.",), ("south coast",), ("nowhere",), (None,)], "x string")
    assert [r[0] for r in df.select(t.state_hint(F.col("x"), hints)).collect()] == ["NSW", "WA", "SA", None, None]
    assert df.select(t.state_hint(F.col("x"), {"al": "X"}, bounded=False)).collect()[1][0] == "X"


def test_written_tables_can_be_dropped(spark):
    import os

    from mentionlab.session import forget, scratch, written

    a = written(spark.range(3), "x")
    path = a._written_path
    assert os.path.exists(path)
    forget(a, spark.range(1))
    assert not os.path.exists(path)
    with scratch(spark) as folder:
        assert written(spark.range(3), "y")._written_path.startswith(folder) and os.path.exists(folder)
    assert not os.path.exists(folder)
