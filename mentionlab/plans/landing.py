"""Queries over a landing zone: files made of the test tables, read back through the harvest forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mentionlab.functions.text import EVENT_TERMS
from mentionlab.operators import corrections as co
from mentionlab.plans import view
from mentionlab.session import shared_dir, table
from mentionlab.sources import landed, sinks, warc
from mentionlab.sources.harvest import fixed_windows

START, END = "2025-09-05", "2025-09-20"
SITES = {
    "daily": landed.Site("d.example", "daily", "https://d.example/sitemap{}.xml", "trailing"),
    "paginated": landed.Site("p.example", "paginated", "https://p.example/sitemap-{}.xml.gz", "dated", pages=6, dated=True),
    "index": landed.Site("i.example", "index", "https://i.example/index.xml", "trailing"),
    "monthly": landed.Site("m.example", "monthly", "https://m.example/{}.xml", "trailing"),
}
SLUG = "concat(CASE page_id % 3 WHEN 0 THEN 'car-crash-on-road' WHEN 1 THEN 'quiet-day-in-town' ELSE 'truck-rollover-report' END, '-', cast(page_id AS VARCHAR(19)))"


def _sql(expression):
    return F.expr(expression.replace("VARCHAR(19)", "STRING"))


#: For each kind: a page's address, and the file that lists it.
PLACES = {
    "daily": ("concat('https://d.example/x/', slug)", "concat('https://d.example/sitemap25090', cast(1 + page_id % 9 AS VARCHAR(19)), '.xml')"),
    "paginated": ("concat('https://p.example/news/2025-09-', lpad(cast(1 + page_id % 28 AS VARCHAR(19)), 2, '0'), '/', slug, '/', cast(1000 + page_id AS VARCHAR(19)))", "concat('https://p.example/sitemap-', cast(page_id % 4 AS VARCHAR(19)), '.xml.gz')"),
    "index": ("concat('https://i.example/y/', slug)", "concat('https://i.example/sitemaps/', cast(2023 + page_id % 4 AS VARCHAR(19)), '/w', cast(page_id % 2 AS VARCHAR(19)), '.xml')"),
    "monthly": ("concat('https://m.example/z/', slug)", "concat('https://m.example/2025-0', cast(1 + page_id % 5 AS VARCHAR(19)), '.xml')"),
}
WINDOWS = {"daily": ("2025-09-01", "2025-09-12"), "paginated": (START, END), "index": ("2024-01-01", "2025-12-31"), "monthly": ("2025-01-15", "2025-06-10")}


def _zone(files):
    """files(address, text) written under the SHA-1 of their addresses; the folder."""
    path = f"{shared_dir(files.sparkSession)}/zone-{uuid.uuid4().hex}"
    files.select(landed.key_of(F.col("address")).alias("key"), "text").repartition("key").write.partitionBy("key").text(path)
    return path


def _sitemaps(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", _sql(SLUG).alias("slug"))
    out = None
    for kind, (loc, file) in PLACES.items():
        mod = F.when((F.col("page_id") % 2 == 0) & F.lit(kind in ("daily", "index")), F.lit("<lastmod>2025-08-15T01:00:00Z</lastmod>")).otherwise("")
        item = F.concat(F.lit("<url><loc>"), _sql(loc), F.lit("</loc>"), mod, F.lit("</url>"))
        one = pages.select(_sql(file).alias("address"), item.alias("item")).groupBy("address").agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("text"))
        out = one if out is None else out.union(one)
    index = out.where("address like 'https://i.example/sitemaps/%'").agg(F.array_join(F.transform(F.array_sort(F.collect_list("address")), lambda a: F.concat(F.lit("<sitemap><loc>"), a, F.lit("</loc></sitemap>"))), "").alias("text"))
    return out.union(index.select(F.lit(SITES["index"].template).alias("address"), "text"))


def _harvested(spark, sf):
    zone = _zone(_sitemaps(spark, sf))
    outlets = spark.createDataFrame([(s.domain, k, i) for i, (k, s) in enumerate(SITES.items())], "domain string, brand string, place int")
    rows = ledger = None
    for kind, site in SITES.items():
        start, end = WINDOWS[kind]
        index = landed.texts(spark, zone, spark.range(1).select(F.sha1(F.lit(site.template)).alias("key"))).select("text") if kind == "index" else None
        got = landed.landed_in(spark, zone, landed.plan(spark, site, start, end, index))
        r, done = landed.harvest_site(site, got, start, end, EVENT_TERMS, outlets)
        rows, ledger = (r, done) if rows is None else (rows.unionByName(r), ledger.unionByName(done))
    return rows, ledger


def sitemap_harvest(spark, sf):
    return _harvested(spark, sf)[0]


def sitemap_ledger(spark, sf):
    return _harvested(spark, sf)[1]


def _items(kind):
    loc, file = PLACES[kind]
    return f"SELECT '{kind}' AS kind, page_id, slug, {loc} AS loc, {file} AS file FROM s".replace("VARCHAR(19)", "VARCHAR")


_ALL = f"s AS (SELECT page_id, {SLUG.replace('VARCHAR(19)', 'VARCHAR')} AS slug FROM pages), it AS ({' UNION ALL '.join(_items(k) for k in PLACES)})"
HARVEST_SQL = f"""WITH {_ALL}, d AS (SELECT *, CASE kind WHEN 'daily' THEN CASE WHEN page_id % 2 = 0 THEN '2025-08-15' ELSE '2025-09-0' || (1 + page_id % 9) END WHEN 'paginated' THEN '2025-09-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0')
  WHEN 'index' THEN CASE WHEN page_id % 2 = 0 THEN '2025-08-15' END ELSE '2025-0' || (1 + page_id % 5) || '-01' END AS day FROM it)
SELECT substr(sha1(loc), 1, 16) AS url_hash, loc AS canonical_url, kind AS domain, '[slug, not real headline] ' || replace(slug, '-', ' ') AS title_at_crawl, day AS seendate, 'sitemap:' || kind[1] || '.example' AS query FROM d
WHERE page_id % 3 <> 1 AND (kind <> 'paginated' OR day BETWEEN '{START}' AND '{END}') AND (kind <> 'index' OR page_id % 4 IN (1, 2))"""
LEDGER_SQL = f"""WITH {_ALL}, c AS (SELECT kind, file, count(*) AS n FROM it GROUP BY 1, 2),
w("window", kind, file) AS (SELECT '2025-09-' || lpad(k::VARCHAR, 2, '0'), 'daily', 'https://d.example/sitemap2509' || lpad(k::VARCHAR, 2, '0') || '.xml' FROM range(1, 13) AS r(k) UNION ALL SELECT k::VARCHAR, 'paginated', 'https://p.example/sitemap-' || k || '.xml.gz' FROM range(0, 6) AS r(k)
  UNION ALL SELECT DISTINCT file, 'index', file FROM it WHERE kind = 'index' AND page_id % 4 IN (1, 2) UNION ALL SELECT '2025-0' || k, 'monthly', 'https://m.example/2025-0' || k || '.xml' FROM range(1, 7) AS r(k))
SELECT 'sitemap:' || kind[1] || '.example' AS tag, "window", coalesce(n, 0) AS n_returned, false AS capped, CASE WHEN n IS NULL THEN 'absent' ELSE 'ok' END AS status FROM w LEFT JOIN c USING (kind, file)"""


def news_harvest(spark, sf):
    """Archived news sitemaps: the archive's index says which, one file is missing."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("2025090"), (F.col("page_id") % 8 + 1).cast("string"), F.lit("000000")).alias("ts"), _sql(SLUG).alias("slug"))
    title = F.concat(F.lit("<news:title>"), F.replace("slug", F.lit("-"), F.lit(" ")), F.lit("</news:title>"))
    item = F.concat(F.lit("<url><loc>https://n.example/"), "slug", F.lit("</loc>"), F.when(F.col("page_id") % 5 > 0, title).otherwise(""), F.when(F.col("page_id") % 2 == 0, F.lit("<news:publication_date>2025-08-30T10:00:00Z</news:publication_date>")).otherwise(""), F.lit("</url>"))
    files = p.where("page_id % 8 < 7").groupBy("ts").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("text"))
    files = files.select(F.concat(F.lit("https://archive.example/"), "ts", F.lit("if_/https://n.example/news.xml")).alias("address"), "text")
    header = '["urlkey","timestamp","original"]'
    each = p.select("ts").distinct().select(F.concat(F.lit('["k","'), "ts", F.lit('","https://n.example/news.xml"]')).alias("x"))
    path = f"{shared_dir(spark)}/cdx-{uuid.uuid4().hex}"
    each.agg(F.concat(F.lit(f"[{header},"), F.array_join(F.array_sort(F.collect_list("x")), ","), F.lit("]")).alias("value")).write.text(path)
    plan = landed.snapshot_plan(landed.snapshots(spark, path, "20250902", "20250908"), "news", "https://archive.example/")
    outlets = spark.createDataFrame([("n.example", "N", 0)], "domain string, brand string, place int")
    return landed.harvest_news(landed.landed_in(spark, _zone(files), plan), EVENT_TERMS, outlets).drop("canonical_url")


NEWS_SQL = f"""WITH s AS (SELECT page_id, {SLUG.replace('VARCHAR(19)', 'VARCHAR')} AS slug FROM pages)
SELECT substr(sha1('https://n.example/' || slug), 1, 16) AS url_hash, 'N' AS domain, replace(slug, '-', ' ') AS title_at_crawl, CASE WHEN page_id % 2 = 0 THEN '2025-08-30' ELSE '2025-09-0' || (page_id % 8 + 1) END AS seendate, 'news' AS query
FROM s WHERE page_id % 3 <> 1 AND page_id % 5 > 0 AND page_id % 8 BETWEEN 1 AND 6"""


def search_answers(spark, sf):
    """Orders of a month as one search answer, read back with its cap; one file is no JSON."""
    from mentionlab.sources.harvest import search_answers as read

    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderkey")
    a = o.groupBy("m").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(F.concat(F.lit("http://o.example/"), k.cast("string")).alias("url"), F.lit("t").alias("title"))).alias("articles"))).alias("text"))
    bad = spark.range(1).select(F.lit("bad").alias("m"), F.lit("<html>busy</html>").alias("text"))
    path = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    a.union(bad).repartition("m").write.partitionBy("m").text(path)
    return read(spark, path).select(F.regexp_extract("file", "m=([^/]+)/", 1).alias("m"), F.col("n_returned").cast("long").alias("n_returned"), "capped", "ok")


#: Days of the windows that events are searched by, and the levels of halves that the ledger may have.
SPAN, LEVELS = 12, 2


def search_windows(spark, sf):
    """A search harvest of events, a query for each type. The ledger has the windows of a plan and of its halves that begin
    on two days of three; what they returned is counted in the table, times 15, up to the cap."""
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    days = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("c"))
    span = e.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    windows = fixed_windows(span, F.col("a"), F.col("b"), SPAN).where("start <= end").select("start", "end")
    plan = windows.join(F.broadcast(e.select("event_type").distinct().orderBy("event_type").limit(100)), how="cross")
    plan = plan.select(F.col("event_type").alias("query"), F.substring(F.sha1("event_type"), 1, landed.QUERY_CHARS).alias("query_hash"), F.lit("daily").alias("pass"), "start", "end")
    half = F.expr("date_add(start, cast(floor(datediff(end, start) / 2) as int))")
    level, every = plan, plan
    for _ in range(LEVELS):
        parts = F.explode(F.array(F.struct(F.col("start").alias("a"), half.alias("b")), F.struct(F.date_add(half, 1).alias("a"), F.col("end").alias("b"))))
        level = level.where("start < end").select("query", "query_hash", "pass", parts.alias("x")).select("query", "query_hash", "pass", F.col("x.a").alias("start"), F.col("x.b").alias("end"))
        every = every.unionByName(level)
    of_day = every.where(F.dayofmonth("start") % 3 > 0).withColumn("day", F.explode(F.sequence("start", "end")))
    counted = of_day.join(days, (F.col("query") == F.col("event_type")) & (of_day.day == days.day), "left").groupBy("query_hash", "start", "end").agg(F.least(F.lit(250), 15 * F.coalesce(F.sum("c"), F.lit(0))).alias("n_returned"))
    found = landed.open_searches(plan, counted.withColumn("ok", F.lit(True)))
    return found.select("query", "pass", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"))


SEARCH_SQL = f"""WITH RECURSIVE e AS (SELECT event_type, ts::DATE AS day FROM events), s AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
p AS (SELECT event_type AS query, (lo + ({SPAN} * k)::INT)::DATE AS a, least((lo + ({SPAN} * k + {SPAN - 1})::INT)::DATE, hi) AS b FROM s, range(0, 4000) AS r(k), (SELECT DISTINCT event_type FROM e) WHERE lo + ({SPAN} * k)::INT <= hi),
t AS (SELECT query, a, b, 0 AS level FROM p UNION ALL SELECT query, CASE x WHEN 0 THEN a ELSE (a + ((b - a) // 2)::INT + 1)::DATE END, CASE x WHEN 0 THEN (a + ((b - a) // 2)::INT)::DATE ELSE b END, level + 1
  FROM (SELECT t.*, least(250, 15 * (SELECT count(*) FROM e WHERE event_type = query AND day BETWEEN a AND b)) AS n FROM t WHERE day(a) % 3 > 0 AND level <= {LEVELS}) AS q, (VALUES (0), (1)) AS v(x) WHERE n >= 250 AND a < b)
SELECT query, 'daily' AS pass, strftime(a, '%Y-%m-%d') AS start, strftime(b, '%Y-%m-%d') AS "end" FROM t WHERE NOT (day(a) % 3 > 0 AND level <= {LEVELS})"""


def csv_study_frame(spark, sf):
    """The view exported as CSV and read as strings, typed, restricted to the population."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(view.view(spark, sf).select("article_id", "incident_id", "outlet", "outcome", "exposed", "entity", "day", "deaths"), path)
    f = landed.study_frame(spark, path, {"article_id": "bigint", "incident_id": "bigint", "outcome": "int", "exposed": "int", "deaths": "int", "day": "date"})
    return f.groupBy("entity", "exposed").agg(F.count(F.lit(1)).alias("articles"), F.sum("article_id").alias("ids"), F.sum("outcome").alias("named"), F.sum("deaths").alias("deaths"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last"))


CSV_SQL = f"WITH {view.MADE}, {view.KNOWN} SELECT entity, exposed, count(*) AS articles, sum(article_id)::BIGINT AS ids, sum(outcome)::BIGINT AS named, sum(deaths)::BIGINT AS deaths, strftime(max(day), '%Y-%m-%d') AS last FROM f GROUP BY 1, 2"


#: Decisions in a file of the review tool: a JSON array is read in one task.
REVIEWED = 20_000


def review_files(spark, sf):
    """Decisions as a review tool writes them, arrays of a bounded number in files, read from JSON and applied."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'O'")
    d = o.select(F.col("o_orderkey").cast("string").alias("incident_id"), F.when(F.col("o_orderstatus") == "F", "accept").otherwise("reject").alias("decision"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).otherwise("").alias("make"), F.lit("why").alias("reason"))
    path = f"{shared_dir(spark)}/review-{uuid.uuid4().hex}"
    files = max(1, -(-d.count() // REVIEWED))
    arrays = d.groupBy(F.pmod(F.xxhash64("incident_id"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)  # an array a file
    i = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("incident_id"), F.lit(0).alias("eligible"), F.lit("old").alias("entity"), F.lit(None).cast("string").alias("reason"))
    return co.adjudicate(i, landed.decisions(spark, path))


def adjudication_queue(spark, sf):
    """The queue of one study window: codings as columns, articles in order, as JSON digests."""
    a = view.articles(spark, sf).select("incident_id", F.col("article_id").alias("published"), "outlet_group", F.col("outlet_group").alias("outlet"), "outcome")
    i = view.incidents(spark, sf).select("incident_id", "day", "entity")
    c = view.incidents(spark, sf).select("incident_id", F.explode(F.create_map(F.lit("deaths"), F.col("deaths").cast("string"), F.lit("tier"), F.col("tier").cast("string"))).alias("variable", "value"))
    q = sinks.adjudication_queue(i, c, a, ["deaths", "tier"], view.START, view.END)
    told = F.array_join(F.transform("articles", lambda x: F.concat_ws(":", x["published"].cast("string"), x["outlet_group"], x["outcome"].cast("string"))), ",")
    return q.select("incident_id", "n_outlets", "deaths", "tier", F.md5(told).alias("articles"))


QUEUE_SQL = f"""WITH {view.MADE}, q AS (SELECT incident_id, count(DISTINCT outlet_group) AS n_outlets, md5(string_agg(article_id || ':' || outlet_group || ':' || outcome, ',' ORDER BY article_id, outlet_group, outlet_group, outcome)) AS articles FROM art GROUP BY 1)
SELECT incident_id, n_outlets, deaths::VARCHAR AS deaths, tier::VARCHAR AS tier, articles FROM q JOIN inci USING (incident_id) WHERE day BETWEEN DATE '1995-03-01' AND DATE '1998-02-28'"""

def warc_pages(spark, sf):
    """Pages as a news crawl: a WARC file for each task, read back in ranges of 64 kB."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), "html")
    head = [F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("page_id") % 10 == 0, "request").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    table(spark, sf, "pages").where("url IS NOT NULL AND html IS NOT NULL").select(F.concat(*head, body)).write.option("lineSep", "\r\n\r\n").text(path)
    return warc.pages(warc.read(spark, path, 1 << 16)).select("url", F.sha2("html", 256).alias("html_sha256"))


QUERIES = {
    "warc_pages": (warc_pages, "SELECT url, sha256(html) AS html_sha256 FROM pages WHERE url IS NOT NULL AND html IS NOT NULL AND page_id % 10 <> 0"),
    "sitemap_harvest": (sitemap_harvest, HARVEST_SQL),
    "sitemap_ledger": (sitemap_ledger, LEDGER_SQL),
    "news_harvest": (news_harvest, NEWS_SQL),
    "search_answers": (search_answers, "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n_returned, count(*) >= 250 AS capped, true AS ok FROM orders GROUP BY 1 UNION ALL SELECT 'bad', 0, false, false"),
    "search_windows": (search_windows, SEARCH_SQL),
    "csv_study_frame": (csv_study_frame, CSV_SQL),
    "review_files": (
        review_files,
        """SELECT o_orderkey::VARCHAR AS incident_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS eligible, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 100000 THEN o_orderpriority END ELSE 'old' END AS entity,
        CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'why' END AS reason FROM orders""",
    ),
    "adjudication_queue": (adjudication_queue, QUEUE_SQL),
}
