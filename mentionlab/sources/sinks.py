"""Exports: CSV, JSON and markdown. Frames are written by executors; only report-sized frames reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import agreement, coding, population

#: Rows of a frame that a markdown report shows at most; a larger frame is refused, not cut.
REPORT_ROWS = 5000


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; files=1 for hand-offs that want one file."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def candidate_rows(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each cluster for the reviewers: first five titles of 120 characters, all URLs, counts, first and last day.

    clusters(doc, cluster), members(doc, title, url, outlet, day)."""
    m = clusters.join(members, "doc").withColumn("_x", F.struct("day", "doc", F.substring("title", 1, 120).alias("title"), "url"))
    g = m.groupBy("cluster").agg(F.array_sort(F.collect_list("_x")).alias("x"), F.count_distinct("outlet").alias("n_outlets"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return g.select("cluster", F.size("x").cast("long").alias("n_articles"), "n_outlets", "first_day", "last_day", F.array_join(F.transform(F.slice("x", 1, 5), lambda a: a["title"]), " || ").alias("titles"), F.array_join(F.transform("x", lambda a: a["url"]), " ").alias("urls"))


def review_json(incidents: DataFrame, articles: DataFrame, key: str = "incident_id") -> DataFrame:
    """Incidents with a nested array of their articles, for review tools: one JSON object for each row."""
    cols = [c for c in articles.columns if c != key]
    nested = articles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("articles"))
    return incidents.join(nested, key, "left")


def adjudication_queue(incidents: DataFrame, codings: DataFrame, articles: DataFrame, variables: list[str], start: str, end: str) -> DataFrame:
    """The reviewers' queue: incidents of the study window that have articles, with the latest codings as columns, the
    articles in order of publication, and their number of outlets.

    incidents(incident_id, day, ...), codings(incident_id, variable, value), articles(incident_id, published, outlet, ...).
    """
    i = population.in_window(incidents, "day", start, end)
    of = codings.where(F.col("variable").isin(variables)).groupBy("incident_id").pivot("variable", variables).agg(F.max("value"))
    cols = ["published", *[c for c in articles.columns if c not in ("incident_id", "published")]]
    nested = articles.groupBy("incident_id").agg(F.count_distinct("outlet").alias("n_outlets"), F.array_sort(F.collect_list(F.struct(*cols))).alias("articles"))
    return i.join(nested, "incident_id").join(of, "incident_id", "left")


def cluster_review(incidents: DataFrame, articles: DataFrame, exposed: str) -> DataFrame:
    """Eligible incidents for the review of their clusters: entity or `(not established)`, whether it is the exposed one, and
    the articles that are not excluded, in order."""
    i = incidents.where("eligible = 1").select("incident_id", "day", F.coalesce(F.when(F.col("entity") != "", F.col("entity")), F.lit("(not established)")).alias("entity"))
    kept = articles.where("excluded = 0").drop("excluded")
    cols = ["published", *[c for c in kept.columns if c not in ("incident_id", "published")]]
    nested = kept.groupBy("incident_id").agg(F.count_distinct("outlet").alias("n_outlets"), F.array_sort(F.collect_list(F.struct(*cols))).alias("articles"))
    return i.withColumn("is_exposed", F.col("entity") == exposed).join(nested, "incident_id", "left").withColumn("n_outlets", F.coalesce("n_outlets", F.lit(0)))


def blinded(units: DataFrame, articles: DataFrame, seed: int = 20260825) -> DataFrame:
    """Sampled units for blind coding: outlet and body without its headlines of each article, in an order that says nothing.

    articles(incident_id, published, outlet, headline, standfirst, body); a missing body is empty."""
    body = t.strip_headlines(F.col("body"), F.col("headline"), F.col("standfirst"))
    a = articles.join(units.select("incident_id").distinct(), "incident_id", "left_semi").select("incident_id", F.struct("published", "outlet", body.alias("body")).alias("a"))
    nested = a.groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: F.struct(x["outlet"].alias("outlet"), x["body"].alias("body"))).alias("articles"))
    return coding.shuffled(units.select("incident_id").join(nested, "incident_id", "left"), "incident_id", seed)


def percent(x: float | None, digits: int = 1) -> str:
    return "-" if x is None else f"{100 * x:.{digits}f} %"


def markdown(df: DataFrame, formats: dict | None = None) -> str:
    """A frame as a markdown table, in its own order."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows are no report")
    show = lambda c, v: "" if v is None else (formats or {}).get(c, lambda x: f"{x:.4g}" if isinstance(x, float) else str(x))(v)
    lines = [df.columns, ["-"] * len(df.columns), *([show(c, r[c]).replace("|", "\\|") for c in df.columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def two_arm_report(compared: DataFrame, drops: DataFrame, by_entity: DataFrame, p: dict) -> str:
    """The study's report: arms, difference, tests, drops, entities; says so where an arm is empty."""
    r = compared.first()
    parts = ["# Two arms", ""]
    if r.n1 is None or r.n0 is None:
        parts.append("One arm is empty: nothing to compare.")
    else:
        parts += [
            f"* exposed: {r.k1}/{r.n1} = {percent(r.p1)} ({percent(r.p1_low)} to {percent(r.p1_high)})",
            f"* others: {r.k0}/{r.n0} = {percent(r.p0)} ({percent(r.p0_low)} to {percent(r.p0_high)})",
            f"* difference {percent(r['diff'])} ({percent(r.diff_low)} to {percent(r.diff_high)}), ratio {'-' if r.ratio is None else format(r.ratio, '.2f')}",
            f"* permutation p {p.get('p')}{' (exact)' if p.get('exact') else ''}",
        ]
    return "\n".join([*parts, "", "## Dropped", "", markdown(drops.orderBy("reason")), "", "## By entity", "", markdown(by_entity.orderBy(F.desc("incidents"), "entity"))])


def validation_report(verdicts: DataFrame, recalls: DataFrame, units: int) -> str:
    """Agreement by variable, recall by entity, the differential, and the verdict of the whole."""
    parts = ["# Validation of machine coding", "", f"Units coded by both: {units}."]
    if units < agreement.FEW_UNITS:
        parts.append(f"Fewer than {agreement.FEW_UNITS} units: too few to rely on.")
    rows = recalls.collect()
    gap = rows[0].differential if rows else None
    parts += ["", "## By variable", "", markdown(verdicts), "", "## Recall by entity", "", markdown(recalls.select("entity", "n", "hits", "recall").orderBy(F.desc("n"), "entity"))]
    if gap is None:
        parts.append("\nNo gold units of both arms: the differential cannot be told, which fails.")
    else:
        word = "within" if abs(gap) <= agreement.MAX_DIFFERENTIAL else "EXCEEDS"
        parts.append(f"\nDifferential {gap:+.2f}: {word} the limit of {agreement.MAX_DIFFERENTIAL:.2f}.")
    return "\n".join([*parts, "", f"**{'PASS' if agreement.passed(verdicts, recalls) else 'FAIL'}**"])


def analysis_report(parts: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """The appendix of models: a heading and a table for each frame, in order; an empty frame is said to be not estimable."""
    out = ["# Models"]
    for name, df in parts.items():
        table = markdown(df)
        out += ["", f"## {name}", "", *([notes[name], ""] if notes and name in notes else []), table if table.count("\n") > 1 else "Not estimable."]
    return "\n".join(out)


def appendix_report(incidents: DataFrame, articles: DataFrame) -> str:
    """Entities by falling number of incidents, under each its incidents by day, under each its articles.

    incidents(incident_id, day, entity), articles(incident_id, published, outlet, headline, named). A report-sized frame: more
    than REPORT_ROWS incidents are refused."""
    cols = F.struct("published", "outlet", "headline", "named")
    nested = articles.groupBy("incident_id").agg(F.array_sort(F.collect_list(cols)).alias("articles"))
    rows = incidents.join(nested, "incident_id", "left").orderBy("day", "incident_id").limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} incidents are no report")
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.entity or "(not established)", []).append(r)
    out = ["# Incidents"]
    for entity in sorted(by, key=lambda e: (-len(by[e]), e)):
        out += ["", f"## {entity} ({len(by[entity])})"]
        for r in by[entity]:
            out += ["", f"### {r.incident_id}, {r.day}", ""]
            out += [f"* {a.outlet}: {a.headline} {'(named)' if a.named else ''}".rstrip() for a in r.articles or []] or ["* no article"]
    return "\n".join(out)
