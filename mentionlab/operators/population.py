"""Who is in the study: the analysis view, its windows and the workflow's semi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import ranks
from mentionlab.session import fresh

#: What a unit's coder is called once a person has decided, and the mark of hand-coded units in their notes.
BY_HAND, GOLD = "human_adjudication", "[GOLD]"
#: Fields that a model's answer must not bring in.
FORBIDDEN = ("headline_names_make", "headline_names_make_strict", "headline_names_second_make", "body_names_make", "first_mention_position")


def analysis_view(articles: DataFrame, incidents: DataFrame, exposed: str) -> DataFrame:
    """Substantive articles that are not excluded, with the columns of their incident if it is eligible and no seed example,
    its year, and whether its entity is the exposed one. Null flags are not 1."""
    a = articles.where("excluded = 0 and substantive = 1")
    i = incidents.where("eligible = 1 and is_seed = 0")
    year = F.year("day")
    return a.join(i, "incident_id").withColumns({"year": year, "exposed": F.coalesce((F.col("entity") == exposed).cast("int"), F.lit(0))})


def in_window(rows: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of days between two ISO dates, both included; a null day is in no window."""
    if start is None and end is None:
        return rows
    bounds = [F.to_date(F.col(day)) >= F.to_date(F.lit(start)) if start else None, F.to_date(F.col(day)) <= F.to_date(F.lit(end)) if end else None]
    on = F.lit(True)
    for b in bounds:
        on = on if b is None else on & b
    return rows.where(on)


def screened(harvest: DataFrame, flag: str = "is_relevant", seen: str = "seendate", start: str | None = None, end: str | None = None, all_topics: bool = False) -> DataFrame:
    """Harvest rows that a classifier has accepted (all_topics: any), seen in a window; times in any of the formats."""
    rows = harvest if all_topics else harvest.where(F.col(flag) == 1)
    (day,) = fresh(rows, "day")
    return in_window(rows.withColumn(day, t.publication_date(F.col(seen))), day, start, end).drop(day)


def covered(articles: DataFrame, min_outlets: int, require_known: bool = True) -> DataFrame:
    """Articles of incidents that enough distinct outlets cover, and (require_known) whose entity is known: the frame of the
    models. Outlets are counted by incident and the article rows semi-joined, not sorted in windows."""
    known = articles.where(F.coalesce(F.col("entity") != "", F.lit(False))) if require_known else articles
    enough = known.groupBy("incident_id").agg(F.count_distinct("outlet").alias("n")).where(F.col("n") >= min_outlets).select("incident_id")
    return known.join(enough, "incident_id", "left_semi")


def unadjudicated(incidents: DataFrame) -> DataFrame:
    """Incidents that no person has decided on; a null coder is none."""
    return incidents.where(~F.col("coded_by").eqNullSafe(F.lit(BY_HAND)))


def uncoded(units: DataFrame, codings: DataFrame, key: str = "incident_id", coder: str | None = None) -> DataFrame:
    """Units without a coding (of that coder)."""
    done = codings if coder is None else codings.where(F.col("coder") == coder)
    return units.join(done.select(key).distinct(), key, "left_anti")


def gold(incidents: DataFrame, ids: DataFrame | None = None, mark: str = GOLD) -> DataFrame:
    """Hand-coded units: those of a list, else those whose notes carry the mark."""
    return incidents.where(F.col("notes").contains(mark)) if ids is None else incidents.join(ids.select("incident_id").distinct(), "incident_id", "left_semi")


def with_articles(incidents: DataFrame, articles: DataFrame) -> DataFrame:
    """Incidents that have an article."""
    return incidents.join(articles.select("incident_id").distinct(), "incident_id", "left_semi")


def articles_of(articles: DataFrame, incidents: DataFrame) -> DataFrame:
    """Articles of these incidents."""
    return articles.join(incidents.select("incident_id").distinct(), "incident_id", "left_semi")


def linked_urls(clusters: DataFrame, harvest: DataFrame, urls: str = "urls", url: str = "canonical_url") -> DataFrame:
    """The harvest rows of each cluster's addresses, which stand in one column with spaces between: cluster columns but that
    one, and the harvest's. An address that the harvest has not, or that is empty, is left out; one that is named twice counts
    once."""
    (own,) = fresh(clusters, "url")
    each = clusters.withColumn(own, F.explode(F.array_distinct(F.filter(F.split(F.trim(urls), r"\s+"), lambda x: x != "")))).drop(urls)
    return each.join(harvest, F.col(own) == harvest[url]).drop(own)


def with_bodies(articles: DataFrame, bodies: DataFrame, how: str = "left") -> DataFrame:
    """articles with the body of bodies(article_id, body): null without one, or (how="inner") those with one only."""
    (own,) = fresh(articles, "id")
    return articles.join(bodies.select(F.col("article_id").alias(own), "body"), F.col("article_id") == F.col(own), how).drop(own)


def without(answers: DataFrame, fields: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """A model's answers without the fields that it must not code."""
    return answers.drop(*[c for c in answers.columns if c.lower() in fields])


def one_per_group(articles: DataFrame, group: str = "syndication", order: tuple[str, ...] = ("article_id",)) -> DataFrame:
    """The first article of each syndication group of an incident, and all that are in no group (null or empty)."""
    alone = F.coalesce(F.col(group).cast("string"), F.lit("")) == ""
    (n,) = fresh(articles, "n")
    first = articles.where(~alone).withColumn(n, F.row_number().over(Window.partitionBy("incident_id", group).orderBy(*order))).where(F.col(n) == 1).drop(n)
    return articles.where(alone).unionByName(first)


def numbered_clusters(clusters: DataFrame, size: str = "size", least: str = "cluster") -> DataFrame:
    """clusters with cluster_id C0001, C0002, ... by falling size, ties by their least member; clusters of one size are spread
    over all tasks like others."""
    (place,) = fresh(clusters, "place")
    out = ranks.numbered(clusters, place, F.desc(size), F.col(least))
    text = F.col(place).cast("string")
    return out.withColumn("cluster_id", F.concat(F.lit("C"), F.lpad(text, F.greatest(F.lit(4), F.length(text)), "0"))).drop(place)


def candidate_clusters(clusters: DataFrame, members: DataFrame, brands: DataFrame, min_brands: int) -> DataFrame:
    """Clusters that enough counting brands cover: clusters(doc, cluster), members(doc, domain), brands(domain, brand,
    counts): cluster, n_articles, n_brands, numbered."""
    of = members.join(brands.where("counts").select("domain", "brand"), "domain", "left")
    each = clusters.select("doc", "cluster").join(of, "doc", "left")
    kept = each.groupBy("cluster").agg(F.count_distinct("doc").alias("n_articles"), F.count_distinct("brand").alias("n_brands")).where(F.col("n_brands") >= min_brands)
    return numbered_clusters(kept, "n_articles", "cluster")


def narrative_incidents(articles: DataFrame, bodies: DataFrame | None = None, patterns: tuple[str, ...] = t.NARRATIVE) -> DataFrame:
    """(incident_id, narrative, by): does any headline of an incident match the narrative's patterns, else any body."""
    rows = articles.select("incident_id", "article_id", F.coalesce("headline", F.lit("")).alias("headline"))
    rows = with_bodies(rows, bodies) if bodies is not None else rows.withColumn("body", F.lit(None).cast("string"))
    found = rows.groupBy("incident_id").agg(F.bool_or(t.narrative(F.col("headline"), patterns)).alias("h"), F.bool_or(t.narrative(F.col("body"), patterns)).alias("b"))
    return found.select("incident_id", (F.col("h") | F.col("b")).alias("narrative"), F.when(F.col("h"), "headline").when(F.col("b"), "body").alias("by"))


def search_products(events: tuple[str, ...], outcomes: tuple[str, ...], sizes: tuple[int, int]) -> list[str]:
    """Search strings "(events) (outcomes)": every chunk of the one with every chunk of the other."""
    from mentionlab.sources.harvest import search_strings

    return [f"{e} {o}" for e in search_strings(events, sizes[0]) for o in search_strings(outcomes, sizes[1])]


