"""Covariates of the models: bins, centring, fills, and the description of the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the group of entities that no group lists.
DEFAULT_GROUP = "mainstream_ice"
UNKNOWN = "unknown"


def deaths_bin(deaths: Column) -> Column:
    """"0" (above -1, to 0), "1" (to 1), "2+" (to 99), else "nan": beyond the bins or null."""
    return F.when((deaths > -1) & (deaths <= 0), "0").when((deaths > 0) & (deaths <= 1), "1").when((deaths > 1) & (deaths <= 99), "2+").otherwise("nan")


def group_of(entity: Column, groups: dict[str, str], default: str = DEFAULT_GROUP) -> Column:
    """An entity's group; those that no group lists, and null, have the default."""
    out = F.lit(default)
    for name, group in groups.items():
        out = F.when(entity == name, group).otherwise(out)
    return out


def prepare(view: DataFrame, groups: dict[str, str] | None = None, categories: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """view with deaths_cat, year_c (the year less the frame's mean over articles), entity_group if groups are given, null
    categories as `unknown` (absent ones too) and null flags as 0."""
    mean = view.agg(F.avg("year")).first()[0]
    made = {"deaths_cat": deaths_bin(F.col("deaths")), "year_c": F.col("year") - F.lit(float(mean or 0.0))}
    made |= {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in view.columns else F.lit(UNKNOWN) for c in categories}
    made |= {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags if c in view.columns}
    if groups is not None:
        made["entity_group"] = group_of(F.col("entity"), groups)
    return view.withColumns(made)


def first_values(articles: DataFrame, columns: tuple[str, ...], order: str) -> DataFrame:
    """One row for each incident: the first value of each column that is not null, in the articles' order."""
    of = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order, F.col(c).alias("v"))))["v"]
    return articles.groupBy("incident_id").agg(*[of(c).alias(c) for c in columns])


def table_one(articles: DataFrame, group: str, order: str, means: tuple[str, ...] = (), flags: tuple[str, ...] = (), shares: dict[str, tuple[str, object]] | None = None, outcomes: tuple[str, ...] = ()) -> DataFrame:
    """By group: incidents, articles, articles_per_incident; of the incidents' first values the mean of `means` (two digits),
    the percentage of `flags` and of shares {name: (column, value)}; of all articles the percentage of `outcomes`.

    Percentages have one digit. A null value is in no mean; in a share it is no match.
    """
    shares = shares or {}
    columns = tuple(dict.fromkeys((group, *means, *flags, *(c for c, _ in shares.values()))))
    inc = first_values(articles, columns, order).where(F.col(group).isNotNull())
    percent = lambda x: F.round(100 * F.avg(x), 1)
    level = inc.groupBy(group).agg(
        F.count(F.lit(1)).alias("incidents"), *[F.round(F.avg(c), 2).alias(f"{c}_mean") for c in means], *[percent(F.col(c)).alias(f"{c}_pct") for c in flags],
        *[percent(F.coalesce((F.col(c) == v).cast("int"), F.lit(0))).alias(f"{n}_pct") for n, (c, v) in shares.items()],
    )
    of = articles.select("incident_id", *outcomes).join(inc.select("incident_id", group), "incident_id")
    below = of.groupBy(group).agg(F.count(F.lit(1)).alias("articles"), *[percent(F.col(c)).alias(f"{c}_pct") for c in outcomes])
    return level.join(below, group).withColumn("articles_per_incident", F.round(F.col("articles") / F.col("incidents"), 1))


def incident_frame(articles: DataFrame, order: str, covariates: tuple[str, ...], outcome: str = "outcome") -> DataFrame:
    """One row for each incident: k, n, failures, prop, exposed, and its first covariates."""
    sums = articles.groupBy("incident_id").agg(F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("k"), F.count(outcome).alias("n"), F.max("exposed").cast("int").alias("exposed"))
    both = sums.join(first_values(articles, covariates, order), "incident_id") if covariates else sums
    return both.withColumns({"failures": F.col("n") - F.col("k"), "prop": F.when(F.col("n") > 0, F.col("k") / F.col("n"))})
