"""From articles to incidents and arms: the two-level aggregation and its comparisons.

Articles have incident_id, outlet, outcome (0/1/null), exposed (0/1), entity (nullable), tier. All functions aggregate
by incident first; incident frames are much smaller than article frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.functions.stats import newcombe, wilson


def known(entity: Column) -> Column:
    return F.coalesce(entity != "", F.lit(False))


def rollup(articles: DataFrame) -> DataFrame:
    """One row for each incident: k (outcomes), n (articles whose outcome is known), outlets, exposed, entity, tier, prop,
    n_null (articles left out because their outcome is null). An article without an outlet counts by its outlet_group, if
    there is such a column."""
    outlet = F.coalesce(F.when(F.col("outlet").cast("string") != "", F.col("outlet").cast("string")), F.col("outlet_group").cast("string")) if "outlet_group" in articles.columns else F.col("outlet")
    return articles.groupBy("incident_id").agg(
        F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k"),
        F.count("outcome").alias("n"),
        F.count_distinct(outlet).alias("outlets"),
        F.max("exposed").cast("int").alias("exposed"),
        F.min("entity").alias("entity"),
        F.min("tier").alias("tier"),
        (F.sum("outcome") / F.count("outcome")).alias("prop"),
        (F.count(F.lit(1)) - F.count("outcome")).alias("n_null"),
    )


def reason(min_outlets: int, tier: str | None = None, require_known: bool = True) -> Column:
    """Why an incident is dropped, the first that holds of tier, entity, outlets; null if it stays."""
    out = F.when(F.col("tier") != tier, "tier") if tier is not None else F.when(F.lit(False), "")
    if require_known:
        out = out.when(~known(F.col("entity")), "entity unknown")
    return out.when(F.col("outlets") < min_outlets, "too few outlets").when(F.col("n") == 0, "no outcome")


def to_incidents(articles: DataFrame, min_outlets: int = 2, tier: str | None = None, require_known: bool = True) -> DataFrame:
    return rollup(articles).where(reason(min_outlets, tier, require_known).isNull())


def drop_reasons(articles: DataFrame, min_outlets: int = 2, tier: str | None = None, require_known: bool = True) -> DataFrame:
    return rollup(articles).groupBy(F.coalesce(reason(min_outlets, tier, require_known), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("incidents"))


def arms(incidents: DataFrame, *by: str) -> DataFrame:
    """Pooled totals of both arms: k1, n1, k0, n0 and the numbers of incidents i1, i0."""
    of = lambda c, x: F.coalesce(F.sum(F.when(F.col("exposed") == x, F.col(c))), F.lit(0))
    made = [of(c, x).alias(f"{c}{x}") for x in (1, 0) for c in ("k", "n")] + [F.count_if(F.col("exposed") == x).alias(f"i{x}") for x in (1, 0)]
    return incidents.groupBy(*by).agg(*made) if by else incidents.agg(*made)


def compared(totals: DataFrame) -> DataFrame:
    """Rates with score intervals, their difference with the hybrid interval, and the ratio; null where an arm is empty,
    a ratio over a zero rate too."""
    k1, n1, k0, n0 = (F.col(c) for c in ("k1", "n1", "k0", "n0"))
    safe = totals.withColumns({"n1": F.when(n1 > 0, n1), "n0": F.when(n0 > 0, n0)})
    (l1, u1), (l0, u0) = wilson(k1, n1), wilson(k0, n0)
    diff, low, high = newcombe(k1, n1, k0, n0)
    return safe.withColumns({"p1": k1 / n1, "p1_low": l1, "p1_high": u1, "p0": k0 / n0, "p0_low": l0, "p0_high": u0, "diff": diff, "diff_low": low, "diff_high": high, "ratio": F.when(k0 > 0, (k1 / n1) / (k0 / n0))})


def ascertainment(incidents: DataFrame) -> DataFrame:
    """Counts by tier and in total (tier null): incidents, eligible, entity unknown."""
    return incidents.rollup("tier").agg(F.count(F.lit(1)).alias("incidents"), F.count_if("eligible").alias("eligible"), F.count_if(~known(F.col("entity"))).alias("entity_unknown"), F.grouping("tier").cast("int").alias("is_total"))


def incident_level(incidents: DataFrame) -> DataFrame:
    """Per arm: median, mean and share at or above one half of the incidents' proportions."""
    return incidents.groupBy("exposed").agg(F.count(F.lit(1)).alias("incidents"), F.percentile("prop", 0.5).alias("median"), F.avg("prop").alias("mean"), (F.count_if(F.col("prop") >= 0.5) / F.count(F.lit(1))).alias("share_half"))


def by_entity(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("entity").agg(F.count(F.lit(1)).alias("incidents"), F.sum("n").alias("articles"), F.sum("k").alias("named"), (F.sum("k") / F.sum("n")).alias("rate"))


def threshold_sweep(articles: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Arms at each outlet threshold, from one roll-up: an incident counts for every threshold it reaches."""
    at = rollup(articles).where(known(F.col("entity")) & (F.col("n") > 0)).select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("min_outlets")).where("outlets >= min_outlets")
    return compared(arms(at, "min_outlets"))


def rates(articles: DataFrame, *by: str) -> DataFrame:
    return articles.groupBy(*by).agg(F.count("outcome").alias("articles"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("named"), (F.sum("outcome") / F.count("outcome")).alias("rate"))


def leave_one_out(articles: DataFrame, column: str) -> DataFrame:
    """Arm rates without each value of a column: totals less the value's own, one pass for all values."""
    sums = [F.sum(F.when(F.col("exposed") == x, v).otherwise(0)).cast("long").alias(f"{c}{x}") for x in (1, 0) for c, v in (("k", F.col("outcome")), ("n", F.lit(1)))]
    own = articles.where(F.col(column).isNotNull() & F.col("outcome").isNotNull()).groupBy(F.col(column).alias("left_out")).agg(*sums)
    whole = own.agg(*[F.sum(c).alias(c) for c in ("k1", "n1", "k0", "n0")]).first()  # one row
    rest = own.select("left_out", *[(F.lit(whole[c]) - F.col(c)).alias(c) for c in ("k1", "n1", "k0", "n0")])
    return rest.withColumns({f"rate{x}": F.when(F.col(f"n{x}") > 0, F.col(f"k{x}") / F.col(f"n{x}")) for x in (1, 0)})


def table_one(incidents: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    """Per arm: incidents, and mean and standard deviation of numeric covariates."""
    return incidents.groupBy("exposed").agg(F.count(F.lit(1)).alias("incidents"), *[f(c).alias(f"{c}_{n}") for c in numeric for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
