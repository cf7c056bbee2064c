"""As-of joins without one task for a key: a range-partitioned union, a last-value window, and what is carried across ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.session import fresh, written

#: Days after publication within which an archived version counts.
VERSION_DAYS = 14


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], forward: bool = False, within: Column | None = None, ranges: int | None = None) -> DataFrame:
    """left with `values` and the time (as `asof_time`) of the row of right with the same key whose time is the last one not
    after the left row's (forward: the first one not before it), nulls without one. within: a condition on
    left_time and asof_time that a match must meet, else it is none.

    Of right rows with equal key and time that with the least values counts. Rows with a null key or time match nothing;
    right rows of that kind are not looked at. Both sides are sorted together by key and time in ranges, so a key with any
    share of the rows is spread; a range needs one row from those before it: their last right row.
    """
    part, own, side, time, key, found = fresh(left, "range", "row", "side", "time", "key", "found")
    payload = F.struct(F.col(right_time).alias("asof_time"), *[F.col(v) for v in values])
    a = left.select(F.col(by).alias(key), F.col(left_time).alias(time), F.lit(1).alias(side), F.struct(*[F.col(c) for c in left.columns]).alias(own))
    known = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull())
    b = known.groupBy(F.col(by).alias(key), F.col(right_time).alias(time)).agg(F.min(payload).alias(found)).withColumn(side, F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col(key), F.col(time).desc() if forward else F.col(time), F.col(side)]
    n = ranges or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.when(F.col(side) == 1, F.monotonically_increasing_id())  # left rows of one key and time are spread too
    (spread,) = fresh(both, "spread")
    laid = written(both.withColumn(spread, tie).repartitionByRange(n, *order, F.col(spread)).withColumn(part, F.spark_partition_id()), "asof")
    so_far = Window.partitionBy(part, key).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = laid.withColumn(found, F.last(F.col(found), True).over(so_far)).where(F.col(side) == 1)
    ends = F.min_by if forward else F.max_by
    last = laid.where(F.col(side) == 0).groupBy(part, key).agg(ends(F.struct(F.col(key).alias("key"), F.col(found).alias("found")), time).alias("last"))
    last = last.groupBy(part).agg(F.max_by("last", key).alias("last"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = laid.select(part).distinct().join(last, part, "left").select(part, F.last("last", True).over(before).alias("carried"))  # a row for each range
    joined = inside.join(F.broadcast(carried), part)
    got = F.coalesce(F.col(found), F.when(F.col("carried.key") == F.col(key), F.col("carried.found")))
    got = F.when(F.col(time).isNotNull() & F.col(key).isNotNull(), got)
    out = joined.select(got.alias(found), f"{own}.*")
    names = ["asof_time", *values]
    out = out.select(*left.columns, *[F.col(found)[v].alias(v) for v in names])
    return out if within is None else out.withColumns({v: F.when(within, F.col(v)) for v in names})


def headline_versions(articles: DataFrame, snapshots: DataFrame, days: int = VERSION_DAYS) -> DataFrame:
    """articles(url, published, crawled, live, ...) with headline and headline_source: the earliest archived version of
    snapshots(url, taken, headline) within `days` of publication, else the title at first crawl, else the live headline.
    Empty headlines are none."""
    some = snapshots.where(F.coalesce(F.col("headline") != "", F.lit(False))).select("url", "taken", F.col("headline").alias("archived"))
    got = asof_join(articles, some, "url", "published", "taken", ["archived"], forward=True, within=F.col("asof_time") <= F.col("published") + F.make_interval(days=F.lit(days)))
    tried = [("archive", F.col("archived")), ("crawl", F.col("crawled")), ("live", F.col("live"))]
    source = F.coalesce(*[F.when(c != "", F.lit(n)) for n, c in tried])
    return got.withColumns({"headline": F.coalesce(*[F.when(c != "", c) for _, c in tried]), "headline_source": source}).drop("archived", "asof_time")
