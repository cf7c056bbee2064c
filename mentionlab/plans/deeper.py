"""Queries of versions, adjusted models and tests of any size on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlab.functions import stats
from mentionlab.functions import text as t
from mentionlab.operators import asof, gazetteer, glmm, models, permutation, reliability, suite
from mentionlab.operators import incidents as inc
from mentionlab.operators import lexicon as lx
from mentionlab.operators import population as pop
from mentionlab.plans import study, view
from mentionlab.plans.text import GOODS
from mentionlab.session import table


def headline_versions(spark, sf):
    """Orders as articles of a customer's address, line items of a supplier as its archived versions."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    crawled = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "")
    a = o.select(F.col("o_orderkey").alias("article_id"), (F.col("o_custkey") % 300).alias("url"), F.col("o_orderdate").alias("published"), crawled.alias("crawled"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("live"))
    s = li.select((F.col("l_suppkey") % 300).alias("url"), F.col("l_shipdate").alias("taken"), F.when(F.col("l_linenumber") % 4 > 0, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).otherwise("").alias("headline"))
    return asof.headline_versions(a, s).select("article_id", "headline", "headline_source")


VERSIONS_SQL = """WITH a AS (SELECT o_orderkey AS article_id, o_custkey % 300 AS url, o_orderdate AS published, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END AS crawled, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS live FROM orders),
s AS (SELECT l_suppkey % 300 AS url, l_shipdate AS taken, min(l_returnflag || l_partkey) AS archived FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1, 2),
j AS (SELECT a.*, CASE WHEN taken <= published + INTERVAL 14 DAY THEN archived END AS archived FROM a ASOF LEFT JOIN s ON a.url = s.url AND a.published <= s.taken)
SELECT article_id, coalesce(archived, nullif(crawled, ''), live) AS headline, CASE WHEN archived IS NOT NULL THEN 'archive' WHEN crawled <> '' THEN 'crawl' WHEN live IS NOT NULL THEN 'live' END AS headline_source FROM j"""


def permutation_incidents(spark, sf):
    """The permutation test on all incidents, and within each tier."""
    i = inc.to_incidents(study.articles(spark, sf)).select("k", "n", "exposed", F.explode(F.array(F.lit("all"), F.concat(F.lit("outlets "), F.least(F.lit(4), F.col("outlets")).cast("string")))).alias("frame"))
    return permutation.permutation_frames(i)


def random_intercepts(spark, sf):
    """The exposure's effect in the model with a random intercept for each incident, beside the GEE's."""
    data, names = suite.design(view._prepared(spark, sf), ("child",), ("register",))
    r = glmm.random_intercept(data, ["exposed", *names])
    return spark.createDataFrame([(r["beta"]["exposed"], r["se"]["exposed"], r["sigma"], r["loglik"], r["clusters"])], "log_or double, se double, sigma double, loglik double, clusters long")


RHOS, RISES = (0.1, 0.3, 0.5), (0.1, 0.25)


def _designs(spark, sf):
    """For each tier: the unexposed arm's rate and articles an incident, and how many exposed incidents there are."""
    t = inc.arms(inc.to_incidents(study.articles(spark, sf)), "tier").where("n0 > 0 AND i1 > 0")
    g = t.select("tier", (F.col("k0") / F.col("n0")).alias("p0"), (F.col("n0") / F.col("i0")).alias("m"), F.col("i1").alias("incidents"), F.explode(F.array(*map(F.lit, RHOS))).alias("rho"))
    return g.where("p0 > 0 AND p0 < 0.7")


def power_of_rollup(spark, sf):
    """Incidents an arm that would show a rise of the rate, by tier."""
    g = _designs(spark, sf).withColumn("rise", F.explode(F.array(*map(F.lit, RISES)))).withColumn("p1", F.col("p0") + F.col("rise"))
    level = F.lit(0.05), F.lit(0.8)
    n = stats.n_per_arm(F.col("p0"), F.col("p1"), *level) * stats.design_effect(F.col("m"), F.col("rho"))
    return g.select("tier", "rho", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"), F.round("m", 9).alias("m"), F.round(n, 5).alias("n_clustered"), stats.clusters_per_arm(F.col("p0"), F.col("p1"), F.col("m"), F.col("rho"), *level).alias("clusters"))


def detectable_of_rollup(spark, sf):
    """The least rate that the exposed incidents that there are would show, by tier."""
    rate = stats.detectable_rate(F.col("p0"), F.col("incidents"), F.col("m"), F.col("rho"), F.lit(0.05), F.lit(0.8))
    return _designs(spark, sf).select("tier", "rho", "incidents", F.round(rate, 6).alias("rate"))


_DESIGNS = f"""{study.ART}, t AS (SELECT tier, {study.TOTALS} FROM i GROUP BY 1), g AS (SELECT tier, k0 / n0 AS p0, n0 / i0 AS m, i1 AS incidents, rho::DOUBLE AS rho
  FROM t, (VALUES {', '.join(f'({r})' for r in RHOS)}) AS v(rho) WHERE n0 > 0 AND i1 > 0 AND k0 > 0 AND k0 / n0 < 0.7)"""
_N = "((1.9599639845 * sqrt(2 * ((p0 + {q}) / 2) * (1 - (p0 + {q}) / 2)) + 0.8416212336 * sqrt(p0 * (1 - p0) + {q} * (1 - {q}))) / ({q} - p0)) ** 2 * (1 + (m - 1) * rho)"
POWER_SQL = f"""WITH {_DESIGNS}, h AS (SELECT *, p0 + rise AS p1 FROM g, (VALUES {', '.join(f'({r}::DOUBLE)' for r in RISES)}) AS w(rise)), n AS (SELECT *, {_N.format(q='p1')} AS n FROM h)
SELECT tier, rho, round(p0, 9) AS p0, round(p1, 9) AS p1, round(m, 9) AS m, round(n, 5) AS n_clustered, ceil(n / m)::BIGINT AS clusters FROM n"""
DETECTABLE_SQL = f"""WITH RECURSIVE {_DESIGNS}, s AS (SELECT *, 0 AS k, p0 + 1e-5 AS low, 0.999::DOUBLE AS high FROM g UNION ALL SELECT tier, p0, m, incidents, rho, k + 1, CASE WHEN short THEN mid ELSE low END, CASE WHEN short THEN high ELSE mid END
  FROM (SELECT *, ceil({_N.format(q='mid')} / m) > incidents AS short FROM (SELECT *, (low + high) / 2 AS mid FROM s WHERE k < 200) AS x) AS y)
SELECT tier, rho, incidents, round(high, 6) AS rate FROM s WHERE k = 200"""

#: Goods whose names do not count next to some words.
WARY = lx.Lexicon(GOODS.entities, rejections={"bolt": (r"\bhot\b", r"\bold\b"), "gizmo": (r"\bsmall\b",), "small": (r"\bring\b",)})


def lexicon_rejections(spark, sf):
    """Entities of part names whose mentions stand without a rejecting word near them, with the tokens that count."""
    found = lx.find_mentions(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", WARY)
    return found.select("p_partkey", F.array_join(F.map_keys("mentions"), ",").alias("named"), F.array_join(F.flatten(F.map_values("mentions")), ",").alias("tokens"))


def _wary_sql():
    """Names are shorter than a window, so a rejecting word anywhere rejects."""
    each = []
    for e in WARY.entities:
        for tok in (*e.aliases, *e.models):
            no = "".join(f" AND NOT regexp_matches(lower(p_name), '{p}')" for p in WARY.rejections.get(tok, ()))
            each.append(f"CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z]){tok}(''s|s''|s)?([^a-z]|$)'){no} THEN {{'e': '{e.name}', 't': '{tok}'}} END")
    return f"SELECT p_partkey, list_filter([{', '.join(each)}], lambda x: x IS NOT NULL) AS f FROM part"


REJECTIONS_SQL = f"""WITH x AS ({_wary_sql()}) SELECT p_partkey, array_to_string(list_filter([{', '.join(f"'{e.name}'" for e in WARY.entities)}], lambda n: list_contains(list_transform(f, lambda y: y.e), n)), ',') AS named,
array_to_string(list_transform(f, lambda y: y.t), ',') AS tokens FROM x"""

#: Headlines in which each pattern of the narrative is told of a page.
TOLD = ("car ploughs into crowd", "a runaway truck", "driver lost control on bend", "ute mounted the kerb", "went into the pub", "wagon rolled twice", "quiet day in town", "controlled landing", "bus crashed through gate", "trolled online")


def narrative_patterns(spark, sf):
    """The narrative's own patterns over headlines made of each event, by incident: a user's events of a type."""
    e = table(spark, sf, "events")
    told = F.get(F.array(*map(F.lit, TOLD)), (F.col("event_id") % len(TOLD)).cast("int"))
    a = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("incident_id"), F.col("event_id").alias("article_id"), F.concat_ws(" ", "event_type", told).alias("headline"))
    return pop.narrative_incidents(a)


NARRATIVE_SQL = f"""WITH a AS (SELECT user_id || '/' || event_type AS incident_id, event_type || ' ' || [{', '.join(f"'{x}'" for x in TOLD)}][event_id % {len(TOLD)} + 1] AS headline FROM events),
g AS (SELECT incident_id, bool_or(regexp_matches(headline, '(?i){'|'.join(t.NARRATIVE)}')) AS h FROM a GROUP BY 1) SELECT incident_id, h AS narrative, CASE WHEN h THEN 'headline' END AS by FROM g"""


def narrative_subgroup(spark, sf):
    """The permutation test inside the incidents of the narrative: documents as articles, a hundred of a source and language
    as an incident."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 10).cast("string")).alias("incident_id"), "text", F.col("lang"))
    told = pop.narrative_incidents(d.select("incident_id", F.col("doc_id").alias("article_id"), F.regexp_extract("text", r"^([^\n]{0,30})", 1).alias("headline")), d.select(F.col("doc_id").alias("article_id"), F.col("text").alias("body")), view.PATTERNS)
    own = d.join(told.where("narrative").select("incident_id"), "incident_id", "left_semi")
    i = own.groupBy("incident_id").agg(F.count_if(F.length("text") % 2 == 0).alias("k"), F.count(F.lit(1)).alias("n"), F.max((F.col("lang") == "en").cast("int")).alias("exposed"))
    return permutation.permutation_frames(i.withColumn("frame", F.lit("narrative")))


#: A gazetteer of words of the documents, some of them inside others, one with two places.
PLACES = [(1, "the", -37.8, 145.0), (2, "is that", -33.9, 151.2), (3, "that", -33.8, 151.0), (4, "und", -27.5, 153.0), (5, "les", -31.9, 115.9), (6, "La", -31.8, 115.8), (7, "que", -34.9, 138.6), (8, "que", 51.5, -0.1), (9, "with", None, None)]


def _named(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.length("text").alias("chars"), "source")
    places = spark.createDataFrame(PLACES, "place_id long, name string, lat double, lon double")
    return d, places, gazetteer.mentions(d, places)


def place_mentions(spark, sf):
    return _named(spark, sf)[2].select(F.col("doc").alias("doc_id"), "place_id", "n")


def located_pairs(spark, sf):
    """Pairs of documents with neighbouring ids that places (30 km) and a count (characters mod 4; unknown if 3) let be one."""
    d, places, named = _named(spark, sf)
    facts = gazetteer.located(d, named, places, F.when(F.col("chars") % 4 < 3, (F.col("chars") % 4).cast("int")))
    pairs = d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(d.select(F.col("doc_id").alias("b")), "b")
    return gazetteer.agreeing(pairs.select("a", "b"), facts, tolerance=1)


_LETTER = r"\p{L}\p{N}"
_GAZETTEER = ", ".join(f"({i}, '{n.lower()}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if a is None else o}::DOUBLE)" for i, n, a, o in PLACES)
#: A name is counted by cutting the text at what surrounds it; `that` counts outside `is that` alone.
_MENTIONS = f"""gz(place_id, name, lat, lon) AS (VALUES {_GAZETTEER}), tx AS (SELECT doc_id, lower(text) AS t, length(text) AS chars FROM documents),
  pieces AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^{_LETTER}])is that([^{_LETTER}]|$)', '\\1is_that\\2', 'g'), '(^|[^{_LETTER}])is that([^{_LETTER}]|$)', '\\1is_that\\2', 'g') AS t FROM tx),
  ws AS (SELECT doc_id, regexp_extract_all(t, '[{_LETTER}_]+') AS w FROM pieces), me AS (SELECT doc_id, place_id, len(list_filter(w, lambda x: x = replace(name, ' ', '_'))) AS n FROM ws, gz)"""
MENTIONS_SQL = f"WITH {_MENTIONS} SELECT doc_id, place_id, n FROM me WHERE n > 0"
PAIRS_SQL = f"""WITH {_MENTIONS}, f AS (SELECT tx.doc_id, CASE WHEN chars % 4 < 3 THEN chars % 4 END AS c, s FROM tx LEFT JOIN (SELECT doc_id, list({{'lat': lat, 'lon': lon}}) AS s FROM me JOIN gz USING (place_id) WHERE n > 0 AND lat IS NOT NULL GROUP BY 1) AS q USING (doc_id))
SELECT x.doc_id AS a, y.doc_id AS b FROM f AS x JOIN f AS y ON y.doc_id = x.doc_id + 1 WHERE (x.c IS NULL OR y.c IS NULL OR abs(x.c - y.c) <= 1) AND (x.s IS NULL OR y.s IS NULL OR len(list_filter(x.s, lambda p: len(list_filter(y.s, lambda q:
  2 * 6371.0088 * asin(sqrt(least(1.0, sin((radians(q.lat) - radians(p.lat)) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(q.lat)) * sin((radians(q.lon) - radians(p.lon)) / 2) ** 2))) <= 30)) > 0)) > 0)"""


def adjusted_quasibinomial(spark, sf):
    """The incident-level model with the study's covariates, dispersion at least 1."""
    data, names = suite.design(view._prepared(spark, sf), ("child", "multi", "year_c"), ("deaths_cat", "age_band"))
    i = data.where("outcome IS NOT NULL").groupBy("incident_id").agg(F.sum("outcome").alias("k"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("exposed", *names)])
    g = models.glm(i, ["exposed", *names])
    odds, low, high, p = models.effect(g["beta"][1], g["se"][1])
    return spark.createDataFrame([(odds, low, high, p, g["scale"])], "odds_ratio double, low double, high double, p double, dispersion double")


def _positions(spark, sf):
    """Two coders' places of orders' lines: by quantity and by price."""
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", F.when(F.col("l_linenumber") % 7 > 0, F.floor(F.col("l_quantity") / 10)).cast("int").alias("a"), F.least(F.lit(4), F.floor(F.col("l_extendedprice") / 20000)).cast("int").alias("b"))


def weighted_agreement(spark, sf):
    """Kappa with squared and with plain distances, by flag."""
    p = _positions(spark, sf)
    both = [reliability.weighted_kappa(p, "a", "b", "l_returnflag", quadratic=q).select("l_returnflag", "n", F.round("weighted_kappa", 9).alias(n)) for q, n in ((True, "squared"), (False, "plain"))]
    return both[0].join(both[1].drop("n"), "l_returnflag")


WEIGHTED_SQL = """WITH p AS (SELECT l_returnflag, CASE WHEN l_linenumber % 7 > 0 THEN floor(l_quantity / 10)::INT END AS a, least(4, floor(l_extendedprice / 20000))::INT AS b FROM lineitem), c AS (SELECT l_returnflag, a, b, count(*) AS c FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
n AS (SELECT l_returnflag, sum(c)::BIGINT AS n, sum(c * (a - b) ** 2) AS s2, sum(c * abs(a - b)) AS s1 FROM c GROUP BY 1), x AS (SELECT l_returnflag, a AS v, sum(c) AS r FROM c GROUP BY 1, 2), y AS (SELECT l_returnflag, b AS w, sum(c) AS k FROM c GROUP BY 1, 2),
e AS (SELECT l_returnflag, sum(r * k * (v - w) ** 2) AS e2, sum(r * k * abs(v - w)) AS e1 FROM x JOIN y USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n, round(1 - s2 * n / e2, 9) AS squared, round(1 - s1 * n / e1, 9) AS plain FROM n JOIN e USING (l_returnflag)"""


def dual_sample(spark, sf):
    """A fifth of the orders of each status, for a second coder."""
    return reliability.sampled_share(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", reliability.DUAL_SHARE, by="o_orderstatus")


DUAL_SQL = """WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('20260101|' || o_orderkey)) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus FROM k WHERE i <= ceil(n * 0.2)"""

QUERIES = {
    "weighted_agreement": (weighted_agreement, WEIGHTED_SQL),
    "dual_sample": (dual_sample, DUAL_SQL),
    "headline_versions": (headline_versions, VERSIONS_SQL),
    "permutation_incidents": (permutation_incidents, None),
    "random_intercepts": (random_intercepts, None),
    "power_of_rollup": (power_of_rollup, POWER_SQL),
    "detectable_of_rollup": (detectable_of_rollup, DETECTABLE_SQL),
    "lexicon_rejections": (lexicon_rejections, REJECTIONS_SQL),
    "narrative_patterns": (narrative_patterns, NARRATIVE_SQL),
    "narrative_subgroup": (narrative_subgroup, None),
    "place_mentions": (place_mentions, MENTIONS_SQL),
    "located_pairs": (located_pairs, PAIRS_SQL),
    "adjusted_quasibinomial": (adjusted_quasibinomial, None),
}
