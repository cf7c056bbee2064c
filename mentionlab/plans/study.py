"""Queries of the two-arm study on the test tables: incident = order, article = line item, outlet = supplier,
outcome = returned, exposure = the order's market segment is AUTOMOBILE."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlab.functions import stats
from mentionlab.operators import incidents as inc
from mentionlab.operators import inference
from mentionlab.session import parts, table

EXPOSED = "AUTOMOBILE"


def articles(spark, sf):
    """One row for each line item; only needed columns are read, and the dimension is joined after pruning."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_suppkey").alias("outlet"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"), (F.col("c_mktsegment") == EXPOSED).cast("int").alias("exposed"),
        F.col("c_mktsegment").alias("entity"), F.col("o_orderstatus").alias("tier"), F.col("l_linestatus").alias("status"), "o_orderdate", "l_shipdate", "l_linenumber", "o_totalprice",
    )


ART = f"""a AS (SELECT l_orderkey AS incident_id, l_suppkey AS outlet, (l_returnflag = 'R')::INT AS outcome, (c_mktsegment = '{EXPOSED}')::INT AS exposed,
  c_mktsegment AS entity, o_orderstatus AS tier, l_linestatus AS status, o_orderdate, l_shipdate, l_linenumber, o_totalprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
r AS (SELECT incident_id, sum(outcome)::BIGINT AS k, count(outcome) AS n, count(DISTINCT outlet) AS outlets, max(exposed) AS exposed, min(entity) AS entity,
  min(tier) AS tier, sum(outcome) / count(outcome) AS prop FROM a GROUP BY 1),
i AS (SELECT * FROM r WHERE entity <> '' AND outlets >= 2 AND n > 0)"""
TOTALS = "coalesce(sum(k) FILTER (exposed = 1), 0)::BIGINT AS k1, coalesce(sum(n) FILTER (exposed = 1), 0)::BIGINT AS n1, coalesce(sum(k) FILTER (exposed = 0), 0)::BIGINT AS k0, coalesce(sum(n) FILTER (exposed = 0), 0)::BIGINT AS n0, count(*) FILTER (exposed = 1) AS i1, count(*) FILTER (exposed = 0) AS i0"


def _wilson(k, n, sign):
    z = stats.Z95
    return f"greatest(0.0, least(1.0, ({k} / {n} + {z * z} / (2 * {n}) {sign} {z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})))"


COMPARED = f"""w AS (SELECT *, k1 / n1 AS p1, k0 / n0 AS p0, {_wilson('k1', 'n1', '-')} AS p1_low, {_wilson('k1', 'n1', '+')} AS p1_high,
  {_wilson('k0', 'n0', '-')} AS p0_low, {_wilson('k0', 'n0', '+')} AS p0_high FROM (SELECT * REPLACE (nullif(n1, 0) AS n1, nullif(n0, 0) AS n0) FROM t)),
z AS (SELECT *, p1 - p0 AS diff, p1 - p0 - sqrt((p1 - p1_low) ** 2 + (p0_high - p0) ** 2) AS diff_low,
  p1 - p0 + sqrt((p1_high - p1) ** 2 + (p0 - p0_low) ** 2) AS diff_high, CASE WHEN k0 > 0 THEN p1 / p0 END AS ratio FROM w)"""


def two_arm_primary(spark, sf):
    return inc.compared(inc.arms(inc.to_incidents(articles(spark, sf))))


def ascertain(spark, sf):
    return inc.ascertainment(inc.rollup(articles(spark, sf)).withColumn("eligible", inc.reason(2).isNull()))


def narrative_cube(spark, sf):
    """Status by exposure with all margins."""
    a = articles(spark, sf).withColumn("exposed", F.col("exposed").cast("string"))
    return a.cube("status", "exposed").agg(F.count_distinct("incident_id").alias("incidents"), F.count(F.lit(1)).alias("articles"), F.sum("outcome").alias("named"), F.avg("outcome").alias("rate"), F.grouping_id().cast("long").alias("level"))


def coverage_window(spark, sf):
    """Interval join: articles published within 14 days from the incident's date."""
    a = articles(spark, sf).withColumn("day", F.datediff("l_shipdate", "o_orderdate"))
    return a.where("day between 0 and 14").groupBy("exposed").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("incident_id").alias("incidents"), F.sum("day").alias("days"))


def contrasts(spark, sf):
    """Each segment against all others, Wald p values of the log odds ratio, Holm-adjusted by name."""
    a = inc.to_incidents(articles(spark, sf))
    by = a.groupBy("entity").agg(F.sum("k").alias("k1"), F.sum("n").alias("n1"))
    return inference.holm(inference.odds_ratios(inference.against_rest(by)), "entity")


CONTRASTS = """e AS (SELECT entity, sum(k) AS k1, sum(n) AS n1 FROM i GROUP BY 1),
o AS (SELECT entity, k1, n1, sum(k1) OVER () - k1 AS k0, sum(n1) OVER () - n1 AS n0 FROM e),
q AS (SELECT entity, k1::BIGINT k1, n1::BIGINT n1, k0::BIGINT k0, n0::BIGINT n0, ln((k1 + 0.5) * (n0 - k0 + 0.5) / ((k0 + 0.5) * (n1 - k1 + 0.5))) AS log_or,
  sqrt(1 / (k1 + 0.5) + 1 / (n1 - k1 + 0.5) + 1 / (k0 + 0.5) + 1 / (n0 - k0 + 0.5)) AS se FROM o),
m AS (SELECT *, log_or / se AS z FROM q), m2 AS (SELECT *, z * z AS chi FROM m)"""


def two_sided_sql(z):
    """P(|N(0,1)| >= z) by the same fit of erfc that the library has."""
    t = f"(1 / (1 + ({z}) / sqrt(2) / 2))"
    power = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        power = f"({power} * {t} + ({c}))"
    return f"({t} * exp(-({z}) * ({z}) / 2 + {power}))"


def odds_contrasts_sql():
    return f"""WITH {ART}, {CONTRASTS},
h AS (SELECT *, {two_sided_sql("abs(z)")} AS p, row_number() OVER (ORDER BY chi DESC, entity) AS rank, count(*) OVER () AS tests FROM m2)
SELECT entity, k1, n1, k0, n0, log_or, se, chi, p, rank, tests - rank + 1 AS multiplier, least(1.0, max((tests - rank + 1) * p) OVER (ORDER BY rank)) AS p_holm FROM h"""


#: As published: replicates of the permutation test and of the bootstrap. They are dealt over few clusters here: an
#: incident is all that customers of one nation ordered, exposed is a nation of one region.
PERMUTATIONS, BOOTSTRAPS, EXPOSED_REGION = 20_000, 1_000, 1


def nations(spark, sf):
    """Nations as clusters: k and n over all their articles."""
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("outcome"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") == EXPOSED_REGION).cast("int").alias("exposed"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_nationkey").alias("incident_id"), "exposed").agg(F.sum("outcome").cast("long").alias("k"), F.count("outcome").alias("n"))


NATIONS = f"""i AS (SELECT n_nationkey AS incident_id, (n_regionkey = {EXPOSED_REGION})::INT AS exposed, sum((l_returnflag = 'R')::INT)::BIGINT AS k, count(l_returnflag) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def permutation(spark, sf):
    return inference.permutation_by_hash(nations(spark, sf), PERMUTATIONS)


def bootstrap(spark, sf):
    return inference.bootstrap_by_hash(nations(spark, sf), BOOTSTRAPS)


def fisher(spark, sf):
    t = inc.arms(inc.to_incidents(articles(spark, sf)))
    return inference.fisher_frame(t)


def matched(spark, sf):
    """Within an order: is the first line returned, is the second; discordance, odds ratio, exact p."""
    a = articles(spark, sf).where("l_linenumber <= 2").groupBy("incident_id").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("outcome"))).alias("x"), F.max(F.when(F.col("l_linenumber") == 2, F.col("outcome"))).alias("y"))
    return inference.discordance(a, "x", "y")


def mann_whitney(spark, sf):
    return inference.mann_whitney(inc.to_incidents(articles(spark, sf)), "prop", "exposed")


GRID = [(p0, p1, m, rho) for p0 in (0.1, 0.3) for p1 in (0.35, 0.5) for m in (4.0, 6.0, 8.0, 12.0) for rho in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)]
ARMS = [(p0, n, m, rho) for p0 in (0.05, 0.1) for n in (10, 15, 20, 25, 30, 40, 60) for m, rho in ((8.0, 0.5), (4.0, 0.2))]


def power_grid(spark, sf):
    g = spark.createDataFrame(GRID, "p0 double, p1 double, m double, rho double")
    level = F.lit(0.05), F.lit(0.8)
    n = stats.n_per_arm(F.col("p0"), F.col("p1"), *level)
    deff = stats.design_effect(F.col("m"), F.col("rho"))
    return g.withColumns({"n_plain": n, "n_clustered": n * deff, "clusters": stats.clusters_per_arm(F.col("p0"), F.col("p1"), F.col("m"), F.col("rho"), *level)})


def detectable(spark, sf):
    """What is detectable with a given number of incidents an arm, and its odds ratio."""
    g = spark.createDataFrame(ARMS, "p0 double, incidents int, m double, rho double")
    rate = stats.detectable_rate(F.col("p0"), F.col("incidents"), F.col("m"), F.col("rho"), F.lit(0.05), F.lit(0.8))
    g = g.withColumn("rate", rate)
    odds = (F.col("rate") / (1 - F.col("rate"))) / (F.col("p0") / (1 - F.col("p0")))
    return g.select("p0", "incidents", "m", "rho", F.round("rate", 6).alias("rate"), F.round(odds, 5).alias("odds_ratio"))


def appendix(spark, sf):
    """Entities by their number of incidents, and a digest of their incidents and articles that needs no order between
    incidents: no entity's rows meet in one task."""
    a = articles(spark, sf)
    one = F.concat_ws(":", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "outlet", "outcome")
    i = a.groupBy("entity", "incident_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("arts"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("=", F.col("incident_id").cast("string"), "arts")), 1, 13), 16, 10).cast("decimal(38,0)")
    return i.groupBy("entity").agg(F.count(F.lit(1)).alias("incidents"), F.sum(digest).cast("string").alias("digest"))


def outlet_report(spark, sf):
    """Articles, distinct incidents and the fifteen largest outlets: a top-k report."""
    a = articles(spark, sf).select("outlet", "incident_id").repartition(parts(table(spark, sf, "lineitem")), "outlet", "incident_id")
    each = a.groupBy("outlet", "incident_id").agg(F.count(F.lit(1)).alias("articles"))
    return each.groupBy("outlet").agg(F.sum("articles").alias("articles"), F.count("incident_id").alias("incidents")).orderBy(F.desc("articles"), "outlet").limit(15)


def _values(rows):
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else f"'{x}'" for x in r) + ")" for r in rows)


QUERIES = {
    "two_arm_primary": (two_arm_primary, f"WITH {ART}, t AS (SELECT {TOTALS} FROM i), {COMPARED} SELECT * FROM z"),
    "incident_rollup": (lambda s, d: inc.to_incidents(articles(s, d)).drop("n_null"), f"WITH {ART} SELECT * FROM i"),
    "drop_reasons": (
        lambda s, d: inc.drop_reasons(articles(s, d), min_outlets=3, tier="F"),
        f"WITH {ART} SELECT CASE WHEN tier <> 'F' THEN 'tier' WHEN NOT coalesce(entity <> '', false) THEN 'entity unknown' WHEN outlets < 3 THEN 'too few outlets' WHEN n = 0 THEN 'no outcome' ELSE 'kept' END AS reason, count(*) AS incidents FROM r GROUP BY 1",
    ),
    "ascertainment": (
        ascertain,
        f"WITH {ART} SELECT tier, count(*) AS incidents, count(*) FILTER (entity <> '' AND outlets >= 2 AND n > 0) AS eligible, count(*) FILTER (NOT coalesce(entity <> '', false)) AS entity_unknown, grouping(tier)::INT AS is_total FROM r GROUP BY ROLLUP (tier)",
    ),
    "by_make": (lambda s, d: inc.by_entity(inc.to_incidents(articles(s, d))), f"WITH {ART} SELECT entity, count(*) AS incidents, sum(n)::BIGINT AS articles, sum(k)::BIGINT AS named, sum(k) / sum(n) AS rate FROM i GROUP BY 1"),
    "incident_level_summary": (
        lambda s, d: inc.incident_level(inc.to_incidents(articles(s, d))),
        f"WITH {ART} SELECT exposed, count(*) AS incidents, median(prop) AS median, avg(prop) AS mean, count(*) FILTER (prop >= 0.5) / count(*) AS share_half FROM i GROUP BY 1",
    ),
    "threshold_sweep": (
        lambda s, d: inc.threshold_sweep(articles(s, d), (1, 2, 3, 5)),
        f"WITH {ART}, t AS (SELECT min_outlets, {TOTALS} FROM r, (VALUES (1), (2), (3), (5)) AS v(min_outlets) WHERE entity <> '' AND n > 0 AND outlets >= min_outlets GROUP BY 1), {COMPARED} SELECT * FROM z",
    ),
    "outlet_rates": (lambda s, d: inc.rates(articles(s, d), "outlet"), f"WITH {ART} SELECT outlet, count(outcome) AS articles, sum(outcome)::BIGINT AS named, sum(outcome) / count(outcome) AS rate FROM a GROUP BY 1"),
    "leave_one_outlet_out": (
        lambda s, d: inc.leave_one_out(articles(s, d), "outlet"),
        f"""WITH {ART}, o AS (SELECT outlet AS left_out, sum(outcome * exposed) AS k1, sum(exposed) AS n1, sum(outcome * (1 - exposed)) AS k0, sum(1 - exposed) AS n0 FROM a GROUP BY 1),
        l AS (SELECT left_out, (sum(k1) OVER () - k1)::BIGINT AS k1, (sum(n1) OVER () - n1)::BIGINT AS n1, (sum(k0) OVER () - k0)::BIGINT AS k0, (sum(n0) OVER () - n0)::BIGINT AS n0 FROM o)
        SELECT *, CASE WHEN n1 > 0 THEN k1 / n1 END AS rate1, CASE WHEN n0 > 0 THEN k0 / n0 END AS rate0 FROM l""",
    ),
    "register_rates": (
        lambda s, d: inc.rates(articles(s, d).join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("outlet") == F.col("s_suppkey")), "s_nationkey", "exposed"),
        f"WITH {ART} SELECT s_nationkey, exposed, count(outcome) AS articles, sum(outcome)::BIGINT AS named, sum(outcome) / count(outcome) AS rate FROM a JOIN supplier ON outlet = s_suppkey GROUP BY 1, 2",
    ),
    "narrative_cube": (
        narrative_cube,
        f"WITH {ART} SELECT status, exposed, count(DISTINCT incident_id) AS incidents, count(*) AS articles, sum(outcome)::BIGINT AS named, avg(outcome) AS rate, grouping(status, exposed)::BIGINT AS level FROM (SELECT * REPLACE (exposed::VARCHAR AS exposed) FROM a) GROUP BY CUBE (status, exposed)",
    ),
    "coverage_window": (
        coverage_window,
        f"WITH {ART}, c AS (SELECT *, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS day FROM a) SELECT exposed, count(*) AS articles, count(DISTINCT incident_id) AS incidents, sum(day)::BIGINT AS days FROM c WHERE day BETWEEN 0 AND 14 GROUP BY 1",
    ),
    "odds_contrasts": (contrasts, odds_contrasts_sql()),
    "permutation_p": (
        permutation,
        f"""WITH {NATIONS}, x AS (SELECT count(*) FILTER (exposed = 1) AS m, sum(k) FILTER (exposed = 1) / sum(n) FILTER (exposed = 1) - sum(k) FILTER (exposed = 0) / sum(n) FILTER (exposed = 0) AS seen FROM i),
        p AS (SELECT rep, k, n, row_number() OVER (PARTITION BY rep ORDER BY md5('20260101|' || rep || '|' || incident_id), incident_id) AS place FROM i, range(1, {PERMUTATIONS + 1}) AS v(rep)),
        d AS (SELECT rep, sum(k) FILTER (place <= m) / sum(n) FILTER (place <= m) - sum(k) FILTER (place > m) / sum(n) FILTER (place > m) AS diff FROM p, x GROUP BY rep)
        SELECT count(*) AS permutations, count(*) FILTER (abs(diff) >= abs(seen) - 1e-12) AS as_extreme, (1 + count(*) FILTER (abs(diff) >= abs(seen) - 1e-12)) / (1 + count(*)) AS p, max(seen) AS observed FROM d, x""",
    ),
    "cluster_bootstrap": (
        bootstrap,
        f"""WITH {NATIONS}, u AS (SELECT rep, exposed, k, n, ('0x' || md5('20260101|' || rep || '|' || incident_id)[1:8])::BIGINT / 4294967296 AS u FROM i, range(1, {BOOTSTRAPS + 1}) AS v(rep)),
        w AS (SELECT *, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3
          WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.999916758850712 THEN 6 ELSE 7 END AS c FROM u),
        d AS (SELECT rep, sum(c * k) FILTER (exposed = 1) / nullif(sum(c * n) FILTER (exposed = 1), 0) - sum(c * k) FILTER (exposed = 0) / nullif(sum(c * n) FILTER (exposed = 0), 0) AS diff FROM w GROUP BY rep)
        SELECT count(*) AS replicates, count(*) - count(diff) AS failed, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM d""",
    ),
    "fisher_exact": (
        fisher,
        f"""WITH {ART}, t AS (SELECT {TOTALS} FROM i), q AS (SELECT k1, n1, k0, n0, x, lgamma(n1 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) + lgamma(n0 + 1) - lgamma(k1 + k0 - x + 1) - lgamma(n0 - k1 - k0 + x + 1) AS lp
          FROM t, unnest(range(greatest(0, k1 + k0 - n0), least(n1, k1 + k0) + 1)) AS v(x)),
        s AS (SELECT *, lgamma(n1 + n0 + 1) - lgamma(k1 + k0 + 1) - lgamma(n1 + n0 - k1 - k0 + 1) AS whole, max(lp) FILTER (x = k1) OVER () AS seen FROM q)
        SELECT max(k1) AS k1, max(n1) AS n1, max(k0) AS k0, max(n0) AS n0, round(sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp - whole) ELSE 0 END), 7) AS p FROM s""",
    ),
    "matched_discordance": (
        matched,
        f"""WITH {ART}, m AS (SELECT incident_id, max(outcome) FILTER (l_linenumber = 1) AS x, max(outcome) FILTER (l_linenumber = 2) AS y FROM a GROUP BY 1),
        d AS (SELECT count(*) FILTER (x = 1 AND y = 1) AS a, count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c, count(*) FILTER (x = 0 AND y = 0) AS d FROM m),
        q AS (SELECT a, b, c, d, unnest(range(0, least(b, c) + 1)) AS k FROM d)
        SELECT max(a) AS a, max(b) AS b, max(c) AS c, max(d) AS d, max(b) / max(c) AS odds_ratio, exp(ln(max(b) / max(c)) - 1.959963985 * sqrt(1 / max(b) + 1 / max(c))) AS low,
          exp(ln(max(b) / max(c)) + 1.959963985 * sqrt(1 / max(b) + 1 / max(c))) AS high,
          round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))), 7) AS p FROM q""",
    ),
    "mann_whitney": (
        mann_whitney,
        f"""WITH {ART}, g AS (SELECT prop AS v, count(*) AS t, count(*) FILTER (exposed = 1) AS t1 FROM i GROUP BY 1),
        k AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM g),
        s AS (SELECT sum(t1)::BIGINT AS n1, (sum(t) - sum(t1))::BIGINT AS n0, sum(t1 * rank) AS r1, sum(t * t * t - t)::DOUBLE AS ties FROM k),
        q AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s)
        SELECT n1, n0, u, (u - n1 * n0 / 2) / sd AS z, least(1.0, {two_sided_sql("greatest(0, abs(u - n1 * n0 / 2) - 0.5) / sd")}) AS p FROM q""",
    ),
    "table_one": (
        lambda s, d: inc.table_one(inc.to_incidents(articles(s, d)), ("n", "outlets", "prop")),
        f"WITH {ART} SELECT exposed, count(*) AS incidents, avg(n) AS n_mean, stddev_samp(n) AS n_sd, avg(outlets) AS outlets_mean, stddev_samp(outlets) AS outlets_sd, avg(prop) AS prop_mean, stddev_samp(prop) AS prop_sd FROM i GROUP BY 1",
    ),
    "detectable_rate": (
        detectable,
        f"""WITH RECURSIVE g(p0, incidents, m, rho) AS (SELECT p0::DOUBLE, incidents::INT, m::DOUBLE, rho::DOUBLE FROM (VALUES {_values(ARMS)}) AS v(p0, incidents, m, rho)),
        s(p0, incidents, m, rho, k, low, high) AS (SELECT p0, incidents, m, rho, 0, p0 + 1e-5, 0.999::DOUBLE FROM g UNION ALL SELECT p0, incidents, m, rho, k + 1,
          CASE WHEN short THEN mid ELSE low END, CASE WHEN short THEN high ELSE mid END FROM (SELECT *, ceil(((1.9599639845 * sqrt(2 * ((p0 + mid) / 2) * (1 - (p0 + mid) / 2))
            + 0.8416212336 * sqrt(p0 * (1 - p0) + mid * (1 - mid))) / (mid - p0)) ** 2 * (1 + (m - 1) * rho) / m) > incidents AS short
          FROM (SELECT *, (low + high) / 2 AS mid FROM s WHERE k < 200) x) y)
        SELECT p0, incidents, m, rho, round(high, 6) AS rate, round((high / (1 - high)) / (p0 / (1 - p0)), 5) AS odds_ratio FROM s WHERE k = 200""",
    ),
    "appendix_grouping": (
        appendix,
        f"""WITH {ART}, x AS (SELECT entity, incident_id, string_agg(lpad(l_linenumber::VARCHAR, 3, '0') || ':' || outlet || ':' || outcome, ',' ORDER BY lpad(l_linenumber::VARCHAR, 3, '0') || ':' || outlet || ':' || outcome) AS arts FROM a GROUP BY 1, 2)
        SELECT entity, count(*) AS incidents, sum(('0x' || md5(incident_id || '=' || arts)[1:13])::BIGINT)::HUGEINT::VARCHAR AS digest FROM x GROUP BY 1""",
    ),
    "outlet_report": (outlet_report, f"WITH {ART} SELECT outlet, count(*) AS articles, count(DISTINCT incident_id) AS incidents FROM a GROUP BY 1 ORDER BY articles DESC, outlet LIMIT 15"),
    "power_grid": (
        power_grid,
        f"""WITH g(p0, p1, m, rho) AS (SELECT p0::DOUBLE, p1::DOUBLE, m::DOUBLE, rho::DOUBLE FROM (VALUES {_values(GRID)}) AS v(p0, p1, m, rho)),
        n AS (SELECT *, ((1.9599639845 * sqrt(2 * ((p0 + p1) / 2) * (1 - (p0 + p1) / 2)) + 0.8416212336 * sqrt(p0 * (1 - p0) + p1 * (1 - p1))) / (p1 - p0)) ** 2 AS n_plain FROM g)
        SELECT *, n_plain * (1 + (m - 1) * rho) AS n_clustered, ceil(n_plain * (1 + (m - 1) * rho) / m)::BIGINT AS clusters FROM n""",
    ),
}
