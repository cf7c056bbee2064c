"""Harvest forms over a landing zone: files that a fetcher has put there, each named by the SHA-1 of its address.

Network work is not the engine's: a plan says which addresses a harvest wants, the zone has those that could be fetched,
and what is joined from it gives harvest rows and a ledger of what is done. Only files that a plan wants are opened. An
address without a file is `absent`, which is done too: the fetcher has tried it. One whose file is damaged, or whose tries
the fetcher's log calls exhausted, is `failed` and stays open.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import population
from mentionlab.operators.corrections import insert_ignore
from mentionlab.session import written
from mentionlab.sources import harvest

#: How many characters of a query's digest name it, and days of the windows of the two search passes.
QUERY_CHARS, DAILY, WIDE = 12, 1, 30
SLUG_MARK = "[slug, not real headline] "


@dataclass(frozen=True)
class Site:
    """A site's sitemaps. kind: daily (template with a day in `pattern`), paginated (template with a page number), index
    (files listed by the index that template names), monthly (template with yyyy-MM)."""

    domain: str
    kind: str
    template: str
    slug: str
    pattern: str = "yyMMdd"
    pages: int = 0
    years: str = r"(20\d\d)"
    dated: bool = False  # the day is in an item's address


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns are strings."""
    return spark.read.option("header", True).csv(path)


def study_frame(spark: SparkSession, path: str, types: dict[str, str], min_outlets: int = 2, require_known: bool = True) -> DataFrame:
    """The models' frame from an exported CSV: columns get their types (what doesn't fit is null), then the population."""
    rows = csv_rows(spark, path)
    return population.covered(rows.withColumns({c: F.col(c).try_cast(k) for c, k in types.items()}), min_outlets, require_known)


def key_of(address: Column) -> Column:
    """The name of an address's file in the landing zone."""
    return F.sha1(address)


#: Paths that one read of a zone names at most; more are read in several parts.
MAX_PATHS = 20_000


def _text(content: bytes) -> tuple[str | None, str | None]:
    """(text, error). Whether it was compressed is told by its first bytes, not by its name."""
    try:
        return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", errors="replace"), None
    except (OSError, EOFError, zlib.error) as e:
        return None, f"{type(e).__name__}: {e}"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)


def texts(spark: SparkSession, zone: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, file, text, error) of the files of a zone, gzip or plain; key is the SHA-1 in the path, if there is one. A damaged
    file has an error and no text. With wanted(key) only files of these keys are opened: the zone is listed first, which
    reads no contents, and paths are read MAX_PATHS at a time."""
    key = F.regexp_extract("path", "([0-9a-f]{40})", 1).alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one file at a time: contents may be large
                text, error = _text(b.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["file", "text", "error"])

    def opened(raw: DataFrame) -> DataFrame:
        return raw.select("path", "content").mapInArrow(run, "file string, text string, error string")

    if wanted is None:
        out = opened(_files(spark, zone))
    else:
        named = _files(spark, zone).select("path", key).join(wanted.select("key").distinct(), "key", "left_semi")
        out, part = None, []
        for r in (*named.select("path").toLocalIterator(), None):
            if r is not None:
                part.append(r.path)
            if part and (r is None or len(part) == MAX_PATHS):
                one = opened(_files(spark, part))
                out, part = one if out is None else out.union(one), []
        out = out if out is not None else spark.createDataFrame([], "file string, text string, error string")
    return out.select(F.regexp_extract("file", "([0-9a-f]{40})", 1).alias("key"), "file", "text", "error")


def frozen(spark: SparkSession, zone: str) -> DataFrame:
    """(file, sha): the first sixteen hex digits of each file's SHA-256, as provenance."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(zone)
    return raw.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.substring(F.sha2("content", 256), 1, 16).alias("sha"))


def plan(spark: SparkSession, site: Site, start: str, end: str, index: DataFrame | None = None) -> DataFrame:
    """(tag, window, address, default_day): what a harvest of a site between two days wants. index: for the kind of that name
    its text, as (text); its files are kept by the year in their path, before any of them is read."""
    tag = F.lit(f"sitemap:{site.domain}").alias("tag")
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    none = F.lit(None).cast("date")
    one = spark.range(1)
    if site.kind == "daily":
        day = one.select(F.explode(F.sequence(a, b)).alias("day"))
        return day.select(tag, F.col("day").cast("string").alias("window"), F.replace(F.lit(site.template), F.lit("{}"), F.date_format("day", site.pattern)).alias("address"), F.col("day").alias("default_day"))
    if site.kind == "paginated":
        page = spark.range(site.pages).select(F.col("id").cast("string").alias("window"))
        return page.select(tag, "window", F.replace(F.lit(site.template), F.lit("{}"), F.col("window")).alias("address"), none.alias("default_day"))
    if site.kind == "monthly":
        month = harvest.month_range(one, a, b)
        return month.select(tag, F.col("month").alias("window"), F.replace(F.lit(site.template), F.lit("{}"), F.col("month")).alias("address"), F.col("first").alias("default_day"))
    if site.kind == "index":
        if index is None:
            raise ValueError("the index is needed")
        files = index.select(F.explode(t.sitemap_items(F.col("text"))).alias("i")).select(F.col("i.loc").alias("address"))
        year = F.regexp_extract("address", site.years, 1).try_cast("int")
        return files.where(year.between(F.year(a), F.year(b))).select(tag, F.col("address").alias("window"), "address", none.alias("default_day"))
    raise ValueError(f"unknown kind of sitemap: {site.kind}")


def open_plan(plan: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The plan's windows that the ledger(tag, window, status) has not as done, with the key of their file."""
    left = plan if ledger is None else plan.join(ledger.where(F.col("status").isin("ok", "absent")).select("tag", "window"), ["tag", "window"], "left_anti")
    return left.withColumn("key", key_of(F.col("address")))


def landed(plan: DataFrame, files: DataFrame, ledger: DataFrame | None = None, tries: DataFrame | None = None) -> DataFrame:
    """The plan's open windows with the text of their file and a status: ok, absent (no file), or failed: the file is damaged,
    or there is none and the fetcher's log tries(address, outcome) says that its tries are exhausted."""
    got = open_plan(plan, ledger).join(files.select("key", "text", *(["error"] if "error" in files.columns else []), F.lit(True).alias("there")), "key", "left").drop("key")
    given_up = F.lit(False)
    if tries is not None:
        got = got.join(tries.where(F.col("outcome") == "exhausted").select("address", F.lit(True).alias("given_up")).distinct(), "address", "left")
        given_up = F.coalesce("given_up", F.lit(False))
    error = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    status = F.when(F.col("there").isNull(), F.when(given_up, "failed").otherwise("absent")).when(error, "failed").otherwise("ok")
    return got.withColumn("status", status).drop("there", "error", "given_up")


def landed_in(spark: SparkSession, zone: str, plan: DataFrame, ledger: DataFrame | None = None, tries: DataFrame | None = None) -> DataFrame:
    """landed() from a zone of which only the files of open windows are opened."""
    return landed(plan, texts(spark, zone, open_plan(plan, ledger).select("key")), ledger, tries)


def harvest_site(site: Site, got: DataFrame, start: str, end: str, terms: tuple[str, ...], outlets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Harvest rows and ledger of landed windows.

    Rows: url_hash, canonical_url, domain (the outlet), title_at_crawl, seendate, query: items whose slug has a keyword, on a
    listed outlet, the first of each address. The day is that in the address, else lastmod, else the window's own. Of
    paginated sitemaps, which are in no order, items count whose address has a day in the window; of indexed ones items
    without a day have none.
    """
    items = t.sitemap_items(F.col("text"))
    each = got.where("text is not null").select("tag", "window", "default_day", F.explode(items).alias("i")).select("tag", "window", "default_day", F.col("i.loc").alias("loc"), F.col("i.lastmod").alias("lastmod"))
    own = t.url_date(F.col("loc")) if site.dated else F.lit(None).cast("date")
    if site.kind == "paginated":
        each = population.in_window(each.withColumn("own", own), "own", start, end).drop("own")
    day = F.coalesce(own, t.lastmod_date(F.col("lastmod")), F.col("default_day"))
    title = t.slug_title(F.col("loc"), site.slug)
    c = t.canonical_url(F.col("loc"))
    rows = each.select("tag", c.alias("canonical_url"), t.host(F.col("loc")).alias("host"), title.alias("title"), F.date_format(day, "yyyy-MM-dd").alias("seendate"))
    rows = harvest.match_outlets(rows.where((F.col("title") != "") & t.keyword(F.col("title"), terms)), "host", outlets)
    first = rows.select(t.url_hash(F.col("canonical_url")).alias("url_hash"), "canonical_url", F.col("brand").alias("domain"), F.concat(F.lit(SLUG_MARK), F.col("title")).alias("title_at_crawl"), "seendate", F.col("tag").alias("query"))
    n = F.coalesce(F.size(t.sitemap_items(F.col("text"))), F.lit(0))
    done = got.select("tag", "window", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_returned"), F.lit(False).alias("capped"), "status")
    return insert_ignore(first, None, "url_hash", ["seendate", "title_at_crawl"]), done


def snapshots(spark: SparkSession, path: str, start: str = "20230101", end: str = "20251231") -> DataFrame:
    """(timestamp, original) of an archive's index, a JSON array of arrays whose first row is the header, within the window."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    each = raw.select(F.posexplode("rows").alias("k", "r")).where("k > 0").select(F.get("r", F.lit(1)).alias("timestamp"), F.get("r", F.lit(2)).alias("original"))
    return each.where(F.substring("timestamp", 1, 8).between(start, end))


def snapshot_plan(found: DataFrame, tag: str, prefix: str) -> DataFrame:
    """Snapshots as a plan: each is fetched under the archive's address; its day is that of its timestamp."""
    address = F.concat(F.lit(prefix), F.col("timestamp"), F.lit("if_/"), F.col("original"))
    return found.select(F.lit(tag).alias("tag"), F.col("timestamp").alias("window"), address.alias("address"), F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("default_day"))


def news_items(xml: Column) -> Column:
    """Array of (loc, title, day) of a news sitemap; blocks without an address or a title are left out."""
    some = lambda b, p: F.when(F.regexp_extract(b, p, 1) != "", F.regexp_extract(b, p, 1))
    item = lambda b: F.struct(
        some(b, r"<loc>([^<]+)</loc>").alias("loc"), some(b, r"<news:title>([^<]+)</news:title>").alias("title"), F.substring(some(b, r"<news:publication_date>([^<]+)</news:publication_date>"), 1, 10).alias("day")
    )
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    return F.filter(F.transform(blocks, item), lambda x: x["loc"].isNotNull() & x["title"].isNotNull())


def harvest_news(got: DataFrame, terms: tuple[str, ...], outlets: DataFrame) -> DataFrame:
    """Harvest rows of landed news sitemaps, with their real titles; a missing day is the window's."""
    each = got.where("text is not null").select("tag", "default_day", F.explode(news_items(F.col("text"))).alias("i")).where(t.keyword(F.col("i.title"), terms))
    c = t.canonical_url(F.col("i.loc"))
    day = F.coalesce(F.col("i.day"), F.date_format("default_day", "yyyy-MM-dd"))
    rows = each.select(c.alias("canonical_url"), t.host(F.col("i.loc")).alias("host"), F.col("i.title").alias("title_at_crawl"), day.alias("seendate"), F.col("tag").alias("query"))
    rows = harvest.match_outlets(rows, "host", outlets)
    return insert_ignore(rows.select(t.url_hash(F.col("canonical_url")).alias("url_hash"), "canonical_url", F.col("brand").alias("domain"), "title_at_crawl", "seendate", "query"), None, "url_hash", ["seendate", "title_at_crawl"])


def search_plan(spark: SparkSession, daily: list[str], wide: list[str], start: str, end: str) -> DataFrame:
    """(query, query_hash, pass, start, end): the two passes of a search harvest, day by day for the first queries and in
    wider windows for the others, which return far less."""
    span = spark.range(1).select(F.to_date(F.lit(start)).alias("a"), F.to_date(F.lit(end)).alias("b"))
    out = None
    for name, queries, days in (("daily", daily, DAILY), ("wide", wide, WIDE)):
        w = harvest.fixed_windows(span, F.col("a"), F.col("b"), days)
        q = w.select(F.explode(F.array(*[F.lit(x) for x in queries])).alias("query"), F.lit(name).alias("pass"), "start", "end") if queries else None
        out = out if q is None else q if out is None else out.union(q)
    return out.select("query", F.substring(F.sha1("query"), 1, QUERY_CHARS).alias("query_hash"), "pass", "start", "end")


def open_searches(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Windows of a plan that the ledger(query_hash, start, end, n_returned, ok) has not. A failed window is open again. One
    that was cut off at the service's cap is replaced by its two halves, and so are these, until none is cut off; a single
    day cannot be cut. Levels are looked up one after another: as many as halvings lead from the longest window to a day."""
    keys = ["query_hash", "start", "end"]
    done = ledger.where("ok").groupBy(*keys).agg(F.max("n_returned").alias("n"))
    half = F.expr("date_add(start, cast(floor(datediff(end, start) / 2) as int))")
    halves = F.array(F.struct(F.col("start").alias("a"), half.alias("b")), F.struct(F.date_add(half, 1).alias("a"), F.col("end").alias("b")))
    level, out = plan.select("query", "query_hash", "pass", "start", "end"), None
    while True:
        looked = written(level.join(done, keys, "left"), "searches")
        todo = looked.where("n is null").drop("n")
        out = todo if out is None else out.unionByName(todo)
        cut = looked.where((F.col("n") >= harvest.CAP) & (F.col("start") < F.col("end")))
        if cut.isEmpty():
            return out.select("query", "query_hash", "pass", "start", "end")
        level = cut.withColumn("x", F.explode(halves)).select("query", "query_hash", "pass", F.col("x.a").alias("start"), F.col("x.b").alias("end"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Reviewers' decisions, a JSON array: incident_id, verdict, entity, why; an entity of no characters is none."""
    rows = spark.read.schema("incident_id string, decision string, verdict string, make string, reason string").option("multiLine", True).json(path)
    return rows.select("incident_id", F.coalesce("verdict", "decision").alias("verdict"), F.when(F.col("make") != "", F.col("make")).alias("entity"), F.col("reason").alias("why"))


def flags(spark: SparkSession, path: str) -> DataFrame:
    """Reviewers' flags on articles, a JSON array: article_id."""
    return spark.read.schema("article_id string").option("multiLine", True).json(path).where("article_id is not null").distinct()
