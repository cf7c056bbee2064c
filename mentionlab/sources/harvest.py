"""Readers of landed harvest files, windows and their ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionlab.functions import text as t
from mentionlab.session import fresh

#: Rows of a search answer from which it counts as cut off.
CAP = 250

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "seendate", "domain")])


def sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(file, loc, lastmod, day) of landed sitemap files, gzip or plain; day from the file's name sitemapYYMMDD if any."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), F.input_file_name().alias("file"))
    items = raw.select("file", F.explode(t.sitemap_items(F.col("xml"))).alias("i"))
    return items.select("file", F.col("i.loc").alias("loc"), F.col("i.lastmod").alias("lastmod"), F.try_to_date(F.regexp_extract("file", r"(\d{6})\.xml(\.gz)?$", 1), "yyMMdd").alias("day"))


def in_years(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Sub-sitemaps whose path names a year in range, before anything of them is read."""
    return files.where(F.regexp_extract(path, r"(20\d\d)", 1).try_cast("int").between(first, last))


def search_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed search answers {"articles": [...]}, one file for each window: file, n_returned, capped, ok, articles. A file
    that is no JSON has ok false."""
    schema = T.StructType([T.StructField("articles", T.ArrayType(ARTICLE)), T.StructField("bad", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("multiLine", True).json(path)
    n = F.coalesce(F.size("articles"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return raw.select(F.input_file_name().alias("file"), n.alias("n_returned"), (n >= CAP).alias("capped"), F.col("bad").isNull().alias("ok"), "articles")


def candidates(items: DataFrame, loc: str, kind: str, terms: tuple[str, ...], lastmod: str | None = None, default_day: Column | None = None) -> DataFrame:
    """Harvest rows of located pages: canonical URL and hash, slug title, publication day (of the URL, else of lastmod, else
    the default), only where the title has a keyword."""
    title = t.slug_title(F.col(loc), kind)
    days = [t.url_date(F.col(loc)), *([t.lastmod_date(F.col(lastmod))] if lastmod else []), *([default_day] if default_day is not None else [])]
    c = t.canonical_url(F.col(loc))
    rows = items.select(c.alias("canonical_url"), t.url_hash(c).alias("url_hash"), t.host(F.col(loc)).alias("domain"), title.alias("title_at_crawl"), F.coalesce(*days).alias("day"))
    return rows.where(t.keyword(F.col("title_at_crawl"), terms))


def fixed_windows(span: DataFrame, start: Column, end: Column, days: int) -> DataFrame:
    """(k, start, end) of windows of `days` over [start, end], the last one cut."""
    n = F.floor(F.datediff(end, start) / days).cast("int")
    w = span.select(start.alias("a"), end.alias("b"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return w.select("k", F.expr(f"date_add(a, k * {days})").alias("start"), F.expr(f"least(date_add(a, k * {days} + {days - 1}), b)").alias("end"))


def month_range(span: DataFrame, start: Column, end: Column) -> DataFrame:
    """(month yyyy-MM, first, last) of each month from start's to end's."""
    first = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("first")
    return span.select(first).select(F.date_format("first", "yyyy-MM").alias("month"), "first", F.last_day("first").alias("last"))


def open_windows(windows: DataFrame, ledger: DataFrame, key: str = "k") -> DataFrame:
    """Windows that the ledger(key, status) has not as done; failed ones are open again."""
    return windows.join(ledger.where(F.col("status").isin("ok", "absent")).select(key), key, "left_anti")


def search_strings(terms: tuple[str, ...], size: int) -> list[str]:
    """Disjunctions of at most `size` quoted terms."""
    return ["(" + " OR ".join(f'"{x}"' if " " in x else x for x in terms[i : i + size]) + ")" for i in range(0, len(terms), size)]


def match_outlets(rows: DataFrame, host: str, outlets: DataFrame, default: str | None = None) -> DataFrame:
    """rows with the brand of their host: outlets(domain, brand, place) match exactly or as a parent domain, the first by
    place wins; hosts of no outlet have the default, or go where that is None.

    Hosts are looked up once each, by their suffixes: an equi-join, whatever the number of domains.
    """
    n = F.size(F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, n), "."))
    hosts = rows.select(F.col(host).alias("host")).where("host is not null").distinct()
    found = hosts.select("host", F.explode(suffix).alias("domain")).join(outlets.select("domain", "brand", "place"), "domain")
    best = found.groupBy("host").agg(F.min(F.struct("place", "brand"))["brand"].alias("brand"))
    own, brand = fresh(rows, "host", "brand")
    best = best.select(F.col("host").alias(own), F.col("brand").alias(brand))
    joined = rows.join(best, F.col(host) == F.col(own), "inner" if default is None else "left")
    return joined.withColumn("brand", F.coalesce(F.col(brand), F.lit(default))).drop(own, brand)
