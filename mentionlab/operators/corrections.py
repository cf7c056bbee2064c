"""Human corrections and keyed upserts as joins: each returns a new snapshot. Frames may have any further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.session import fresh

#: Who a row was coded by after a merge and after a split.
BY_HAND, PENDING, RECODE = "human_adjudication", "suggested_pending_confirmation", "needs_recoding"


def adjudicate(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions(incident_id, verdict, entity, why): accept makes eligible with the given entity (or none) and no reason,
    reject makes ineligible with its reason. Without a decision rows stay. Of repeated decisions the last by verdict."""
    own, d = fresh(incidents, "id", "decision")
    made = decisions.groupBy(F.col("incident_id").alias(own)).agg(F.max(F.struct("verdict", "entity", "why")).alias(d))
    j = incidents.join(made, F.col("incident_id") == F.col(own), "left")
    yes, no = F.col(d)["verdict"] == "accept", F.col(d)["verdict"] == "reject"
    return j.withColumns(
        {
            "eligible": F.when(yes, 1).when(no, 0).otherwise(F.col("eligible")),
            "entity": F.when(yes, F.col(d)["entity"]).otherwise(F.col("entity")),
            "reason": F.when(yes, None).when(no, F.col(d)["why"]).otherwise(F.col("reason")),
        }
    ).drop(own, d)


def decision_stats(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions by verdict, those for unknown incidents as `unknown`."""
    (own,) = fresh(decisions, "id")
    known = incidents.select(F.col("incident_id").alias(own)).distinct()
    status = F.when(F.col(own).isNull(), "unknown").otherwise(F.col("verdict"))
    return decisions.join(known, F.col("incident_id") == F.col(own), "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("decisions"))


def exclude(articles: DataFrame, flags: DataFrame, key: str = "article_id") -> DataFrame:
    """articles with excluded = 1 where flagged."""
    (own,) = fresh(articles, "key")
    f = flags.select(F.col(key).alias(own)).distinct()
    return articles.join(f, F.col(key) == F.col(own), "left").withColumn("excluded", F.col(own).isNotNull().cast("int")).drop(own)


def _mapped(rows: DataFrame, key: Column, mapping: DataFrame, value: Column) -> DataFrame:
    """rows with incident_id replaced by a mapping's (from, to) where it has one for the key."""
    a, b = fresh(rows, "from", "to")
    m = mapping.select(F.col("from").alias(a), F.col("to").alias(b))
    return rows.join(m, key == F.col(a), "left").withColumn("incident_id", F.coalesce(F.col(b), value)).drop(a, b)


def merge(articles: DataFrame, merges: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """merges(source, target): articles of a source move to its target. Merges into themselves and, with incidents, those
    from or to an unknown incident do nothing."""
    return _mapped(articles, F.col("incident_id"), _merges(merges, incidents), F.col("incident_id"))


def _merges(merges: DataFrame, incidents: DataFrame | None) -> DataFrame:
    m = merges.where("source <> target").groupBy(F.col("source").alias("from")).agg(F.min("target").alias("to"))
    if incidents is None:
        return m
    for end in ("from", "to"):
        m = m.join(incidents.select(F.col("incident_id").alias(end)).distinct(), end, "left_semi")
    return m


def merged_incidents(incidents: DataFrame, merges: DataFrame) -> DataFrame:
    """incidents(incident_id, eligible, reason, coded_by, second) after merges(source, target, second): a merged one is no
    longer eligible and says into which it went; a target takes a second entity if the merge names one."""
    m = _merges(merges, incidents)
    a, b, c, d = fresh(incidents, "from", "to", "into", "second")
    gone = m.select(F.col("from").alias(a), F.col("to").alias(b))
    named = merges.where("second is not null").groupBy(F.col("target").alias(c)).agg(F.min("second").alias(d))
    j = incidents.join(gone, F.col("incident_id") == F.col(a), "left").join(named, F.col("incident_id") == F.col(c), "left")
    went = F.col(b).isNotNull()
    why = F.concat(F.lit("merged into "), F.col(b).cast("string"))
    return j.withColumns(
        {
            "eligible": F.when(went, 0).otherwise(F.col("eligible")),
            "reason": F.when(went, why).otherwise(F.col("reason")),
            "coded_by": F.when(went, BY_HAND).otherwise(F.col("coded_by")),
            "second": F.coalesce(F.col(d), F.col("second")),
        }
    ).drop(a, b, c, d)


def split(articles: DataFrame, moves: DataFrame, key: str = "article_id") -> DataFrame:
    """moves(article, target): listed articles go to a new incident."""
    m = moves.groupBy(F.col("article").alias("from")).agg(F.min("target").alias("to"))
    return _mapped(articles, F.col(key), m, F.col("incident_id"))


def split_incidents(incidents: DataFrame, splits: DataFrame) -> DataFrame:
    """incidents(incident_id, day, eligible, entity, second, multi, coded_by) after splits(source, target, day, entity,
    second, eligible): each gives a new row, and its source must be coded anew. Splits from an unknown incident or to a
    known one do nothing."""
    ids = incidents.select("incident_id").distinct()
    s = splits.join(ids.withColumnRenamed("incident_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("incident_id", "target"), "target", "left_anti")
    ok = F.coalesce(F.col("eligible").cast("int"), F.lit(0))
    new = s.select(
        F.col("target").alias("incident_id"), "day", ok.alias("eligible"), "entity", "second", F.col("second").isNotNull().cast("int").alias("multi"),
        F.when(ok > 0, BY_HAND).otherwise(PENDING).alias("coded_by"),
    )
    (own,) = fresh(incidents, "source")
    j = incidents.join(s.select(F.col("source").alias(own)).distinct(), F.col("incident_id") == F.col(own), "left")
    was = F.col(own).isNotNull()
    reset = {"eligible": F.lit(0), "entity": F.lit(None), "second": F.lit(None), "multi": F.lit(0), "coded_by": F.lit(RECODE)}
    old = j.withColumns({c: F.when(was, v).otherwise(F.col(c)) for c, v in reset.items()}).drop(own)
    return old.unionByName(new, allowMissingColumns=True)


def padded(number: Column) -> Column:
    """A number as text of two digits at least."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), "0")


def next_ids(new: DataFrame, existing: DataFrame, date: str, order: str) -> DataFrame:
    """new with incident_id YYYYMMDD-nn: numbers go on after the greatest of that date's existing ids. Two digits at least;
    a number from 100 on is whole."""
    own, day, n = fresh(new, "own", "day", "last")
    last = existing.select(F.substring("incident_id", 1, 8).alias(day), F.regexp_extract("incident_id", r"(\d+)$", 1).cast("int").alias(n)).groupBy(day).agg(F.max(n).alias(n))
    number = F.row_number().over(Window.partitionBy(own).orderBy(order)) + F.coalesce(F.col(n), F.lit(0))
    joined = new.withColumn(own, F.date_format(date, "yyyyMMdd")).join(last, F.col(own) == F.col(day), "left")
    return joined.withColumn("incident_id", F.concat(F.col(own), F.lit("-"), padded(number))).drop(own, day, n)


def route(members: DataFrame, linked: DataFrame) -> DataFrame:
    """members(cluster, url), linked(url, incident_id): a cluster whose articles have no incident is new, one makes it an
    addition to it, more are ambiguous."""
    j = members.select("cluster", "url").join(linked.select(F.col("url").alias("_url"), "incident_id"), F.col("url") == F.col("_url"), "left")
    g = j.groupBy("cluster").agg(F.count_distinct("incident_id").alias("incidents"), F.min("incident_id").alias("first"))
    kind = F.when(F.col("incidents") == 0, "new").when(F.col("incidents") == 1, "augment").otherwise("ambiguous")
    return g.select("cluster", "incidents", kind.alias("route"), F.when(F.col("incidents") == 1, F.col("first")).alias("incident_id"))


def insert_ignore(rows: DataFrame, existing: DataFrame | None, key: str, order: list) -> DataFrame:
    """Rows whose key is new, the first of each by `order`; null keys are left out."""
    (n,) = fresh(rows, "n")
    first = rows.where(F.col(key).isNotNull()).withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) == 1).drop(n)
    return first if existing is None else first.join(existing.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: upserts of (unit, variable, coder) codings."""
    (n,) = fresh(rows, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def wide(codings: DataFrame, unit: str, variable: str, value: str, variables: list[str]) -> DataFrame:
    """Codings as one column for each listed variable."""
    return codings.groupBy(unit).pivot(variable, variables).agg(F.max(value))
