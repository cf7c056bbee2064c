"""Queries of the analysis view, the workflow's joins, covariates and closed-form models on the test tables: an article is a
line item, an incident an order; the columns that the tables lack are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlab.operators import agreement as ag
from mentionlab.operators import corrections as co
from mentionlab.operators import covariates as cv
from mentionlab.operators import incidents as inc
from mentionlab.operators import population as pop
from mentionlab.operators import similarity as sim
from mentionlab.operators import suite
from mentionlab.plans.study import COMPARED, TOTALS, two_sided_sql
from mentionlab.session import parts, table, written
from mentionlab.sources.harvest import fixed_windows

EXPOSED = "AUTOMOBILE"
GROUPS = {"AUTOMOBILE": "exposed", "BUILDING": "other_bev", "MACHINERY": "premium"}
#: Order of an incident's articles; line numbers repeat in the test tables.
FIRST = ("article_id", "outlet_group", "outlet", "outcome", "body", "strict")
START, END = "1995-03-01", "1998-02-28"

#: Columns of the made tables; the same expressions run in both engines.
ARTICLE = {
    "article_id": "l_orderkey * 10 + l_linenumber", "incident_id": "l_orderkey", "outlet": "nullif(cast(l_suppkey % 11 AS VARCHAR(9)), '0')", "outlet_group": "concat('g', cast(l_suppkey % 3 AS VARCHAR(9)))",
    "register": "l_linestatus", "is_wire": "CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END", "syndication": "CASE WHEN l_partkey % 3 = 0 THEN concat('S', cast(l_partkey % 2 AS VARCHAR(9))) END",
    "outcome": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "strict": "CASE WHEN l_returnflag = 'R' AND l_quantity > 10 THEN 1 ELSE 0 END", "body": "CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END",
    "excluded": "CASE WHEN l_linenumber = 7 THEN 1 WHEN l_partkey % 41 = 0 THEN NULL ELSE 0 END", "substantive": "CASE WHEN l_quantity >= 2 THEN 1 ELSE 0 END",
}
INCIDENT = {
    "incident_id": "o_orderkey", "day": "cast(o_orderdate AS DATE)", "eligible": "CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END", "is_seed": "CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END",
    "entity": "CASE WHEN o_custkey % 13 = 0 THEN '' WHEN o_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END", "tier": "cast(1 + o_orderkey % 2 AS INT)",
    "deaths": "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 120 ELSE cast(o_orderkey % 4 AS INT) END", "child": "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END",
    "multi": "CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END", "age_band": "CASE WHEN o_custkey % 3 = 0 THEN '<=2y' WHEN o_custkey % 3 = 1 THEN NULL ELSE '>2y' END", "notes": "CASE WHEN o_orderkey % 37 = 0 THEN 'seen [GOLD] twice' WHEN o_orderkey % 2 = 0 THEN 'gold' END",
    "coded_by": "CASE WHEN o_orderkey % 3 = 0 THEN 'human_adjudication' WHEN o_orderkey % 3 = 1 THEN 'model' END",
}


def _made(df, columns):
    return df.select(*[F.expr(e.replace("VARCHAR(9)", "STRING")).alias(c) for c, e in columns.items()])


def articles(spark, sf):
    return _made(table(spark, sf, "lineitem"), ARTICLE)


def incidents(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return _made(o, INCIDENT)


def view(spark, sf):
    return pop.analysis_view(articles(spark, sf), incidents(spark, sf), EXPOSED)


def _select(columns):
    return ", ".join(f"{e.replace('VARCHAR(9)', 'VARCHAR')} AS {c}" for c, e in columns.items())


MADE = f"""art AS (SELECT {_select(ARTICLE)} FROM lineitem), inci AS (SELECT {_select(INCIDENT)} FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT art.*, inci.* EXCLUDE (incident_id), year(day)::INT AS year, coalesce((entity = '{EXPOSED}')::INT, 0) AS exposed FROM art JOIN inci USING (incident_id)
  WHERE excluded = 0 AND substantive = 1 AND eligible = 1 AND is_seed = 0)"""
KNOWN = """kn AS (SELECT * FROM v WHERE entity <> ''), cov AS (SELECT incident_id FROM kn GROUP BY 1 HAVING count(DISTINCT outlet) >= 2),
f AS (SELECT * FROM kn SEMI JOIN cov USING (incident_id))"""


#: What the models and descriptions of the frame read.
FRAME = (
    "incident_id", "article_id", "outlet", "outlet_group", "register", "is_wire", "syndication", "outcome", "strict", "body",
    "entity", "tier", "deaths", "child", "multi", "age_band", "year", "exposed",
)


def frame(spark, sf):
    """The models' frame: known entity, two outlets. It is read several times, so it is joined once and written, in tasks of
    a bounded number of articles."""
    a = articles(spark, sf).repartition(parts(table(spark, sf, "lineitem")), "incident_id")
    v = pop.analysis_view(a, incidents(spark, sf), EXPOSED)
    return written(pop.covered(v.select(*FRAME), 2), "frame")


def analysis_view(spark, sf):
    return view(spark, sf).groupBy("year", "exposed").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("incident_id").alias("incidents"), F.sum("article_id").alias("ids"))


def fallback_rollup(spark, sf):
    """The roll-up of the view in the study window, outlets without a name counted by their group."""
    return inc.to_incidents(pop.in_window(view(spark, sf), "day", START, END), 2).select("incident_id", "k", "n", "outlets", "exposed", "entity")


def two_arm_view(spark, sf):
    return inc.compared(inc.arms(inc.to_incidents(pop.in_window(view(spark, sf), "day", START, END), 2)))


def screened(spark, sf):
    """Events as harvest rows: accepted ones seen in a window, times in two formats."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 3 > 0).cast("int")).alias("is_relevant"))
    first = table(spark, sf, "events").agg(F.min(F.to_date("ts"))).first()[0]
    return pop.screened(e, start=str(first), end=str(first)).select("event_id")


def workflow(spark, sf):
    """Incidents at each step: undecided, uncoded, gold, with an article in the view; and their articles."""
    i, a = incidents(spark, sf), view(spark, sf)
    codings = i.where("coded_by = 'model'").select("incident_id", F.lit("model").alias("coder"))
    steps = {"undecided": pop.unadjudicated(i), "uncoded": pop.uncoded(i, codings, coder="model"), "gold": pop.gold(i), "listed": pop.gold(i, i.where("tier = 2").select("incident_id")), "with articles": pop.with_articles(i, a)}
    steps["articles of gold"] = pop.articles_of(a, pop.gold(i))
    out = None
    for name, df in steps.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("incident_id").alias("ids")).select(F.lit(name).alias("step"), "n", "ids")
        out = one if out is None else out.union(one)
    return out


def bodies(spark, sf):
    """Articles with bodies where there are any: documents as bodies of the orders' first lines."""
    b = table(spark, sf, "documents").select((F.col("doc_id") * 10 + 1).alias("article_id"), F.col("text").alias("body")).where("body is not null")
    a = articles(spark, sf).select("article_id", "register")
    joined = pop.with_bodies(a, b).groupBy("register").agg(F.count(F.lit(1)).alias("articles"), F.count("body").alias("bodies"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))
    return joined


def one_per_wire(spark, sf):
    v = view(spark, sf)
    return pop.one_per_group(v, order=FIRST).groupBy("incident_id").agg(F.count(F.lit(1)).alias("articles"), F.sum("article_id").alias("ids"))


def numbering(spark, sf):
    """Customers as clusters of orders, by falling size."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return pop.numbered_clusters(c)


def candidates(spark, sf):
    """Clusters = customers, domains = priorities, of which one does not count."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("domain"))
    names = o.select("domain").distinct().select("domain", F.substring("domain", 3, 3).alias("brand"), (F.substring("domain", 1, 1) != "5").alias("counts"))
    return pop.candidate_clusters(o.select("doc", "cluster"), o.select("doc", "domain"), names, 3)


PATTERNS = (r"thing", r"und der")


def narratives(spark, sf):
    """Documents as articles of the incidents that share source and language and a hundred; the first line is the headline."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 10).cast("string")).alias("incident_id"), F.regexp_extract("text", r"^([^\n]{0,30})", 1).alias("headline"), "text")
    b = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("article_id"), F.col("text").alias("body"))
    return pop.narrative_incidents(d.withColumnRenamed("doc_id", "article_id").drop("text"), b, PATTERNS)


def covariate_rows(spark, sf):
    p = cv.prepare(view(spark, sf), GROUPS, ("age_band", "register", "remoteness"), ("child", "multi"))
    return p.groupBy("deaths_cat", "entity_group", "age_band", "remoteness", "child").agg(F.count(F.lit(1)).alias("articles"), F.round(F.sum("year_c"), 6).alias("year_sum"))


def table_one(spark, sf):
    p = cv.prepare(frame(spark, sf), GROUPS, ("age_band",), ("child", "multi"))
    return cv.table_one(p, "entity_group", "article_id", ("deaths",), ("child", "multi"), {"new": ("age_band", "<=2y"), "tier1": ("tier", 1)}, ("outcome", "body"))


def incident_covariates(spark, sf):
    return cv.incident_frame(frame(spark, sf), "article_id", ("deaths", "age_band", "tier")).drop("prop")


def _robust(df):
    return df.select("frame", "n", "clusters", "exposed_clusters", *[F.round(c, 7).alias(c) for c in ("log_or", "se", "odds_ratio", "low", "high", "p")])


def contrast_odds(spark, sf):
    rows = cv.prepare(frame(spark, sf), GROUPS)
    fits = suite.contrasts(rows, {"against other_bev": ("exposed", "other_bev"), "against premium": ("exposed", "premium"), "against all": ("exposed", "other_bev", "premium", cv.DEFAULT_GROUP)})
    return _robust(fits).join(fits.select("frame", F.round("p_holm", 7).alias("p_holm")), "frame")


def control_odds(spark, sf):
    return _robust(suite.controls(frame(spark, sf), "body", F.col("entity") == "BUILDING", F.col("exposed") == 1))


def sensitivity_odds(spark, sf):
    """The frames of the sensitivity analyses, fitted in one pass."""
    rows = frame(spark, sf)
    plain = rows.select("incident_id", "article_id", "syndication", "exposed", "outcome", "strict", "tier", "is_wire")
    named = suite.framed(plain, {"all": F.lit(True), "tier 1": F.col("tier") == 1, "no wire": F.col("is_wire") == 0, "strict": F.lit(True)})
    named = named.withColumn("outcome", F.when(F.col("frame") == "strict", F.col("strict")).otherwise(F.col("outcome")))
    wire = pop.one_per_group(rows, order=FIRST).withColumn("frame", F.lit("one per wire group"))
    return _robust(suite.robust_odds(named.select("frame", "incident_id", "exposed", "outcome").unionByName(wire.select("frame", "incident_id", "exposed", "outcome"))))


def subgroup_odds(spark, sf):
    return _robust(suite.subgroups(frame(spark, sf), ("register", "tier", "age_band", "year")))


CATEGORIES, FLAGS = ("age_band", "register", "remoteness"), ("child", "multi")
NUMERIC, CATEGORICAL = ("child", "multi", "year_c"), ("deaths_cat", "age_band", "remoteness", "register")


def _prepared(spark, sf):
    return cv.prepare(frame(spark, sf), GROUPS, CATEGORIES, FLAGS)


def _adjusted(df):
    return df.select("frame", "n", *[F.round(c, 6).alias(c) for c in ("log_or", "se", "odds_ratio", "low", "high", "p")])


def adjusted_contrasts(spark, sf):
    """The exposed entity against two groups, adjusted, with the matched pairs of its incidents with several vehicles: the
    article names the one, the other."""
    from mentionlab.operators.inference import discordance

    rows = _prepared(spark, sf)
    pairs = rows.where("exposed = 1 AND multi = 1")
    fits = suite.adjusted_contrasts(rows, {"against other_bev": ("exposed", "other_bev"), "against premium": ("exposed", "premium")}, NUMERIC, CATEGORICAL, matched=discordance(pairs, "outcome", "body"))
    return _adjusted(fits).join(fits.select("frame", F.round("p_holm", 6).alias("p_holm")), "frame")


def adjusted_controls(spark, sf):
    return _adjusted(suite.adjusted_controls(_prepared(spark, sf), "body", F.col("entity") == "BUILDING", NUMERIC, CATEGORICAL))


def adjusted_sensitivities(spark, sf):
    rows = _prepared(spark, sf).select("incident_id", "article_id", "outlet_group", "outlet", "syndication", "exposed", "outcome", "strict", "body", "tier", "is_wire", *NUMERIC, *CATEGORICAL)
    parts = {"all": F.lit(True), "tier 1": F.col("tier") == 1, "no wire": F.col("is_wire") == 0}
    return _adjusted(suite.adjusted_sensitivities(rows, parts, NUMERIC, CATEGORICAL, {"strict": "strict"}, pop.one_per_group(rows, order=FIRST)))


def exchangeable_subgroups(spark, sf):
    return _adjusted(suite.exchangeable_subgroups(frame(spark, sf), ("register", "tier", "age_band", "year")))


def adjusted_bootstrap(spark, sf):
    """The percentile interval of the adjusted model over resampled incidents."""
    from mentionlab.operators.frames import bootstrap_adjusted

    data, names = suite.design(_prepared(spark, sf), NUMERIC, CATEGORICAL)
    r = bootstrap_adjusted(data, "exposed", names)
    return spark.createDataFrame([(r["replicates"], r["failed"], r["low"], r["high"])], "replicates long, failed long, low double, high double")


def _codings(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    gold = lab.select("doc_id", "lang", F.col("quality").alias("good"), (F.col("n_chars") % 7).alias("size"), F.lit(None).cast("string").alias("never"))
    machine = lab.where("doc_id % 5 > 0").select("doc_id", F.when(F.col("doc_id") % 19 > 0, F.col("lang")).otherwise("xx").alias("lang"), F.when(F.col("doc_id") % 4 > 0, F.col("quality")).otherwise(0).alias("good"), F.when(F.col("doc_id") % 9 > 0, F.col("n_chars") % 7).otherwise(-1).alias("size"), F.lit(None).cast("string").alias("never"))
    return gold, machine


def validation(spark, sf):
    gold, machine = _codings(spark, sf)
    v = ag.verdicts(gold, machine, "doc_id", ["lang", "good", "never"], ["size"], exposure="lang")
    return v.select("variable", "n", F.round("exact", 9).alias("exact"), F.round("kappa", 9).alias("kappa"), "threshold", "verdict")


def disagreement(spark, sf):
    return ag.disagreements(*_codings(spark, sf), "doc_id", "lang")


def _merges(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    to = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("target"))
    m = o.join(to, "o_custkey").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source"), "target", F.when(F.col("o_custkey") % 2 == 0, "twice").alias("second"))
    return m.union(o.where("o_orderkey % 5 = 0").select(-F.col("o_orderkey") - 1, F.col("o_orderkey"), F.lit(None).cast("string")))


def merged(spark, sf):
    i = incidents(spark, sf).select("incident_id", "eligible", "coded_by").withColumns({"reason": F.lit(None).cast("string"), "second": F.lit(None).cast("string")})
    return co.merged_incidents(i, _merges(spark, sf))


def splits(spark, sf):
    i = incidents(spark, sf).select("incident_id", F.col("day").cast("string").alias("day"), "eligible", "entity", F.lit(None).cast("string").alias("second"), "multi", "coded_by")
    i = i.repartition(parts(table(spark, sf, "orders")), "incident_id")  # one layout for all of its joins
    s = i.where("incident_id % 7 = 0").select(F.col("incident_id").alias("source"), F.when(F.col("incident_id") % 2 == 0, -F.col("incident_id") - 1).otherwise(F.col("incident_id")).alias("target"), F.lit("2026-01-01").alias("day"), F.lit("new").alias("entity"), F.when(F.col("incident_id") % 4 == 0, "other").alias("second"), (F.col("incident_id") % 3 == 0).alias("eligible"))
    return co.split_incidents(i, s)


def url_links(spark, sf):
    """Clusters' space-joined URLs, exploded and joined to the harvest."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = o.groupBy(F.col("o_custkey").alias("cluster")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("http://u.example/"), F.col("o_orderkey").cast("string")))), " ").alias("urls"))
    harvest = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("http://u.example/"), F.col("o_orderkey").cast("string")).alias("canonical_url"), F.col("o_orderkey").alias("harvest_id"))
    return pop.linked_urls(c, harvest).groupBy("cluster").agg(F.count(F.lit(1)).alias("linked"), F.sum("harvest_id").alias("ids"))


def dense_pairs(spark, sf):
    """Each vector with the next one by id."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(sim.dense_cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


def months(spark, sf):
    """Months of the orders' dates."""
    from mentionlab.sources.harvest import month_range

    span = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return month_range(span, F.col("a"), F.col("b")).select("month", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


def days(spark, sf):
    """Daily windows over the orders' dates."""
    span = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return fixed_windows(span, F.col("a"), F.col("b"), 1).select("k", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"))


def model_rows(spark, sf):
    """Adjusted models on the frame; no SQL has them."""
    p = cv.prepare(frame(spark, sf), GROUPS, ("age_band",), ("child", "multi"))
    rows = p.selectExpr("incident_id", "cast(outcome as double) outcome", "cast(exposed as double) exposed", "cast(child as double) child", "cast(is_wire as double) is_wire", "year_c", "deaths_cat", "register")
    return suite.model_suite(spark, rows, "exposed", ("child", "year_c"), ("deaths_cat", "register"), ("is_wire",))


def threshold_tests(spark, sf):
    return suite.sweep_with_tests(spark, inc.rollup(frame(spark, sf)), (1, 2, 3, 5))


def bootstrap(spark, sf):
    from mentionlab.operators.inference import bootstrap_by_strata

    r = bootstrap_by_strata(inc.to_incidents(frame(spark, sf)))
    return spark.createDataFrame([tuple(r.values())], "replicates long, odds_failed long, odds_low double, odds_high double, diff_failed long, diff_low double, diff_high double")


def narrative_test(spark, sf):
    """The permutation test inside the subgroup of one narrative: orders whose number has a digit of it."""
    from mentionlab.operators.inference import permutation_by_strata

    r = permutation_by_strata(inc.to_incidents(frame(spark, sf).where("register = 'O'")))
    return spark.createDataFrame([(r["observed"], r["p"], r["exact"])], "observed double, p double, exact boolean")


def _odds_sql(frames, least=0, hot=0):
    """Closed-form fits of frames x(frame, incident_id, outcome, exposed)."""
    z = "1.959963985"
    return f"""x AS ({frames}), c AS (SELECT frame, incident_id, max(exposed) AS x, sum(outcome) AS k, count(*) AS n FROM x WHERE outcome IS NOT NULL GROUP BY 1, 2),
    am AS (SELECT frame, x, sum(k)::DOUBLE AS ka, sum(n)::DOUBLE AS na, count(*) AS cl FROM c GROUP BY 1, 2),
    vr AS (SELECT frame, x, any_value(ka) AS ka, any_value(na) AS na, any_value(cl) AS cl, sum((k - n * ka / na) ** 2) AS ss FROM c JOIN am USING (frame, x) GROUP BY 1, 2),
    lg AS (SELECT frame, x, na, cl, CASE WHEN ka > 0 AND ka < na THEN ln(ka / (na - ka)) END AS lo, CASE WHEN ka > 0 AND ka < na THEN ss / (ka * (1 - ka / na)) ** 2 END AS v FROM vr),
    ft AS (SELECT frame, sum(na)::BIGINT AS n, sum(cl)::BIGINT AS clusters, coalesce(max(cl) FILTER (x = 1), 0)::BIGINT AS exposed_clusters, max(lo) FILTER (x = 1) - max(lo) FILTER (x = 0) AS b, sqrt(max(v) FILTER (x = 1) + max(v) FILTER (x = 0)) AS s FROM lg GROUP BY 1),
    gt AS (SELECT * REPLACE (CASE WHEN n >= {least} AND exposed_clusters >= {hot} AND s > 0 THEN b END AS b, CASE WHEN n >= {least} AND exposed_clusters >= {hot} AND s > 0 THEN s END AS s) FROM ft),
    od AS (SELECT frame, n, clusters, exposed_clusters, b AS log_or, s AS se, exp(b) AS odds_ratio, exp(b - {z} * s) AS low, exp(b + {z} * s) AS high, {two_sided_sql("abs(b / s)")} AS p FROM gt)"""


_SHOWN = "frame, n, clusters, exposed_clusters, round(log_or, 7) AS log_or, round(se, 7) AS se, round(odds_ratio, 7) AS odds_ratio, round(low, 7) AS low, round(high, 7) AS high, round(p, 7) AS p"
_GROUP = "CASE entity " + " ".join(f"WHEN '{e}' THEN '{g}'" for e, g in GROUPS.items()) + f" ELSE '{cv.DEFAULT_GROUP}' END"
_BIN = "CASE WHEN deaths > -1 AND deaths <= 0 THEN '0' WHEN deaths > 0 AND deaths <= 1 THEN '1' WHEN deaths > 1 AND deaths <= 99 THEN '2+' ELSE 'nan' END"
_ROLL = """r AS (SELECT incident_id, sum(outcome)::BIGINT AS k, count(outcome) AS n, count(DISTINCT coalesce(nullif(outlet, ''), outlet_group)) AS outlets, max(exposed) AS exposed, min(entity) AS entity
  FROM v WHERE day BETWEEN DATE '1995-03-01' AND DATE '1998-02-28' GROUP BY 1), i AS (SELECT * FROM r WHERE entity <> '' AND outlets >= 2 AND n > 0)"""
_CODED = """lab AS (SELECT labels.*, lang, n_chars FROM labels JOIN documents USING (doc_id)), g AS (SELECT doc_id, coalesce(lang, '') AS lang, quality::VARCHAR AS good, (n_chars % 7)::VARCHAR AS size FROM lab),
  m AS (SELECT doc_id, CASE WHEN doc_id % 19 > 0 THEN coalesce(lang, '') ELSE 'xx' END AS lang, CASE WHEN doc_id % 4 > 0 THEN quality::VARCHAR ELSE '0' END AS good, CASE WHEN doc_id % 9 > 0 THEN (n_chars % 7)::VARCHAR ELSE '-1' END AS size FROM lab WHERE doc_id % 5 > 0)"""

QUERIES = {
    "analysis_view": (analysis_view, f"WITH {MADE} SELECT year, exposed, count(*) AS articles, count(DISTINCT incident_id) AS incidents, sum(article_id)::BIGINT AS ids FROM v GROUP BY 1, 2"),
    "outlet_fallback_rollup": (fallback_rollup, f"WITH {MADE}, {_ROLL} SELECT * FROM i"),
    "two_arm_view": (two_arm_view, f"WITH {MADE}, {_ROLL}, t AS (SELECT {TOTALS} FROM i), {COMPARED} SELECT * FROM z"),
    "screened_harvest": (screened, "SELECT event_id FROM events WHERE event_id % 7 > 0 AND event_id % 3 > 0 AND ts::DATE = (SELECT min(ts::DATE) FROM events)"),
    "workflow_joins": (
        workflow,
        f"""WITH {MADE}, s(step, incident_id) AS (SELECT 'undecided', incident_id FROM inci WHERE coded_by IS DISTINCT FROM 'human_adjudication' UNION ALL SELECT 'uncoded', incident_id FROM inci WHERE coded_by IS DISTINCT FROM 'model'
          UNION ALL SELECT 'gold', incident_id FROM inci WHERE notes LIKE '%[GOLD]%' UNION ALL SELECT 'listed', incident_id FROM inci WHERE tier = 2 UNION ALL SELECT 'with articles', incident_id FROM inci WHERE incident_id IN (SELECT incident_id FROM v)
          UNION ALL SELECT 'articles of gold', incident_id FROM v WHERE notes LIKE '%[GOLD]%') SELECT step, count(*) AS n, sum(incident_id)::BIGINT AS ids FROM s GROUP BY 1""",
    ),
    "article_bodies": (bodies, f"WITH {MADE} SELECT register, count(*) AS articles, count(text) AS bodies, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM art LEFT JOIN documents ON article_id = doc_id * 10 + 1 GROUP BY 1"),
    "one_per_wire_group": (
        one_per_wire,
        f"""WITH {MADE}, k AS (SELECT *, row_number() OVER (PARTITION BY incident_id, syndication ORDER BY article_id, outlet_group, outlet NULLS FIRST, outcome, body, strict) AS nr FROM v)
        SELECT incident_id, count(*) AS articles, sum(article_id)::BIGINT AS ids FROM k WHERE coalesce(syndication, '') = '' OR nr = 1 GROUP BY 1""",
    ),
    "cluster_numbers": (numbering, "WITH c AS (SELECT o_custkey AS cluster, count(*) AS size FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster) AS nr FROM c) SELECT cluster, size, 'C' || lpad(nr::VARCHAR, greatest(4, length(nr::VARCHAR))::INT, '0') AS cluster_id FROM k"),
    "candidate_clusters": (
        candidates,
        """WITH c AS (SELECT o_custkey AS cluster, count(*) AS n_articles, count(DISTINCT substr(o_orderpriority, 3, 3)) FILTER (o_orderpriority[1] <> '5') AS n_brands FROM orders GROUP BY 1 HAVING n_brands >= 3),
        k AS (SELECT *, row_number() OVER (ORDER BY n_articles DESC, cluster) AS nr FROM c) SELECT cluster, n_articles, n_brands, 'C' || lpad(nr::VARCHAR, greatest(4, length(nr::VARCHAR))::INT, '0') AS cluster_id FROM k""",
    ),
    "narrative_incidents": (
        narratives,
        """WITH d AS (SELECT doc_id, concat_ws('/', source, lang, (doc_id // 10)::VARCHAR) AS incident_id, regexp_extract(text, '^([^\\n]{0,30})', 1) AS headline, CASE WHEN doc_id % 3 > 0 THEN text END AS body FROM documents),
        g AS (SELECT incident_id, bool_or(coalesce(regexp_matches(headline, '(?i)thing|und der'), false)) AS h, bool_or(coalesce(regexp_matches(body, '(?i)thing|und der'), false)) AS b FROM d GROUP BY 1)
        SELECT incident_id, h OR b AS narrative, CASE WHEN h THEN 'headline' WHEN b THEN 'body' END AS by FROM g""",
    ),
    "covariates": (
        covariate_rows,
        f"""WITH {MADE}, y AS (SELECT avg(year) AS m FROM v) SELECT {_BIN} AS deaths_cat, {_GROUP} AS entity_group, coalesce(age_band, 'unknown') AS age_band, 'unknown' AS remoteness, coalesce(child, 0) AS child, count(*) AS articles, round(sum(year - m), 6) AS year_sum FROM v, y GROUP BY ALL""",
    ),
    "table_one_groups": (
        table_one,
        f"""WITH {MADE}, {KNOWN}, p AS (SELECT * REPLACE (coalesce(child, 0) AS child), {_GROUP} AS entity_group FROM f), g AS (SELECT incident_id, any_value(entity_group) AS entity_group, any_value(deaths) AS deaths, any_value(child) AS child, any_value(multi) AS multi, any_value(age_band) AS age_band, any_value(tier) AS tier FROM p GROUP BY 1),
        a AS (SELECT entity_group, count(*) AS incidents, round(avg(deaths), 2) AS deaths_mean, round(100 * avg(child), 1) AS child_pct, round(100 * avg(multi), 1) AS multi_pct, round(100 * avg(coalesce((age_band = '<=2y')::INT, 0)), 1) AS new_pct, round(100 * avg((tier = 1)::INT), 1) AS tier1_pct FROM g GROUP BY 1),
        b AS (SELECT entity_group, count(*) AS articles, round(100 * avg(outcome), 1) AS outcome_pct, round(100 * avg(body), 1) AS body_pct FROM p GROUP BY 1)
        SELECT *, round(articles / incidents, 1) AS articles_per_incident FROM a JOIN b USING (entity_group)""",
    ),
    "incident_covariates": (
        incident_covariates,
        f"WITH {MADE}, {KNOWN} SELECT incident_id, sum(outcome)::BIGINT AS k, count(outcome) AS n, max(exposed) AS exposed, any_value(deaths) AS deaths, any_value(age_band) AS age_band, any_value(tier) AS tier, (count(outcome) - sum(outcome))::BIGINT AS failures FROM f GROUP BY 1",
    ),
    "contrast_odds": (
        contrast_odds,
        f"""WITH {MADE}, {KNOWN}, gr AS (SELECT *, {_GROUP} AS eg FROM f), {_odds_sql("SELECT 'against other_bev' AS frame, incident_id, outcome, exposed FROM gr WHERE eg IN ('exposed', 'other_bev') UNION ALL SELECT 'against premium', incident_id, outcome, exposed FROM gr WHERE eg IN ('exposed', 'premium') UNION ALL SELECT 'against all', incident_id, outcome, exposed FROM gr", 30)},
        rk AS (SELECT *, row_number() OVER (ORDER BY p, frame) AS nr, count(*) OVER () AS tests FROM od WHERE p IS NOT NULL) SELECT {_SHOWN}, round(least(1.0, max((tests - nr + 1) * p) OVER (ORDER BY nr)), 7) AS p_holm FROM rk""",
    ),
    "control_odds": (
        control_odds,
        f"""WITH {MADE}, {KNOWN}, {_odds_sql("SELECT 'outcome control' AS frame, incident_id, body AS outcome, exposed FROM f UNION ALL SELECT 'exposure control', incident_id, outcome, (entity = 'BUILDING')::INT FROM f WHERE exposed = 0")} SELECT {_SHOWN} FROM od""",
    ),
    "sensitivity_odds": (
        sensitivity_odds,
        f"""WITH {MADE}, {KNOWN}, wk AS (SELECT *, row_number() OVER (PARTITION BY incident_id, syndication ORDER BY article_id, outlet_group, outlet NULLS FIRST, outcome, body, strict) AS nr FROM f), {_odds_sql("SELECT 'all' AS frame, incident_id, outcome, exposed FROM f UNION ALL SELECT 'tier 1', incident_id, outcome, exposed FROM f WHERE tier = 1 UNION ALL SELECT 'no wire', incident_id, outcome, exposed FROM f WHERE is_wire = 0 UNION ALL SELECT 'strict', incident_id, strict, exposed FROM f UNION ALL SELECT 'one per wire group', incident_id, outcome, exposed FROM wk WHERE coalesce(syndication, '') = '' OR nr = 1")}
        SELECT {_SHOWN} FROM od""",
    ),
    "subgroup_odds": (
        subgroup_odds,
        f"""WITH {MADE}, {KNOWN}, {_odds_sql("SELECT unnest(['register = ' || register, 'tier = ' || tier, 'age_band = ' || coalesce(age_band, 'unknown'), 'year = ' || year]) AS frame, incident_id, outcome, exposed FROM f", 40, 5)} SELECT {_SHOWN} FROM od""",
    ),
    "validation_verdicts": (
        validation,
        f"""WITH {_CODED}, p AS (SELECT 'lang' AS variable, g.lang AS x, m.lang AS y FROM g JOIN m USING (doc_id) UNION ALL SELECT 'good', g.good, m.good FROM g JOIN m USING (doc_id) UNION ALL SELECT 'size', g.size, m.size FROM g JOIN m USING (doc_id)),
        q AS (SELECT * FROM p WHERE x <> '' OR y <> ''), t AS (SELECT variable, count(*) AS n, avg((x = y)::INT) AS exact FROM q GROUP BY 1),
        e AS (SELECT variable, sum(a.c * b.c) AS rk FROM (SELECT variable, x AS v, count(*) AS c FROM q GROUP BY 1, 2) AS a JOIN (SELECT variable, y AS v, count(*) AS c FROM q GROUP BY 1, 2) AS b USING (variable, v) GROUP BY 1),
        k AS (SELECT variable, n, exact, CASE WHEN variable <> 'size' AND coalesce(rk, 0) / (n * n) < 1 THEN (exact - coalesce(rk, 0) / (n * n)) / (1 - coalesce(rk, 0) / (n * n)) END AS kappa FROM t LEFT JOIN e USING (variable)),
        l AS (SELECT *, CASE WHEN variable = 'lang' THEN 0.9 WHEN kappa IS NOT NULL THEN 0.7 ELSE 0.85 END::DOUBLE AS threshold FROM k)
        SELECT variable, n, round(exact, 9) AS exact, round(kappa, 9) AS kappa, threshold, CASE WHEN coalesce(kappa, exact) >= threshold THEN 'pass' ELSE 'FAIL' END AS verdict FROM l UNION ALL SELECT 'never', 0, NULL, NULL, NULL, 'no data'""",
    ),
    "disagreement_list": (disagreement, f"WITH {_CODED} SELECT doc_id, g.lang AS your_answer, m.lang AS machine_answer FROM g JOIN m USING (doc_id) WHERE g.lang <> m.lang"),
    "merged_incidents": (
        merged,
        f"""WITH {MADE}, t AS (SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS target FROM orders), m AS (SELECT o_orderkey AS source, target, CASE WHEN o_custkey % 2 = 0 THEN 'twice' END AS second FROM t WHERE o_orderkey % 3 = 0),
        n AS (SELECT target, max(second) AS second FROM m GROUP BY 1)
        SELECT incident_id, CASE WHEN m.source <> m.target THEN 0 ELSE eligible END AS eligible, CASE WHEN m.source <> m.target THEN 'human_adjudication' ELSE coded_by END AS coded_by,
        CASE WHEN m.source <> m.target THEN 'merged into ' || m.target END AS reason, n.second FROM inci LEFT JOIN m ON source = incident_id LEFT JOIN n ON n.target = incident_id""",
    ),
    "split_incidents": (
        splits,
        f"""WITH {MADE}, s AS (SELECT incident_id FROM inci WHERE incident_id % 7 = 0 AND incident_id % 2 = 0)
        SELECT incident_id, day::VARCHAR AS day, CASE WHEN x THEN 0 ELSE eligible END AS eligible, CASE WHEN NOT x THEN entity END AS entity, NULL AS second, CASE WHEN x THEN 0 ELSE multi END AS multi, CASE WHEN x THEN 'needs_recoding' ELSE coded_by END AS coded_by
        FROM (SELECT *, incident_id IN (SELECT incident_id FROM s) AS x FROM inci) AS i
        UNION ALL SELECT -incident_id - 1, '2026-01-01', (incident_id % 3 = 0)::INT, 'new', CASE WHEN incident_id % 4 = 0 THEN 'other' END, (incident_id % 4 = 0)::INT, CASE WHEN incident_id % 3 = 0 THEN 'human_adjudication' ELSE 'suggested_pending_confirmation' END FROM s""",
    ),
    "url_links": (url_links, "SELECT o_custkey AS cluster, count(*) AS linked, sum(o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1"),
    "embedding_cosine": (dense_pairs, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1"),
    "month_range": (
        months,
        """WITH s AS (SELECT date_trunc('month', min(o_orderdate))::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), m AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS d FROM s)
        SELECT strftime(d, '%Y-%m') AS month, strftime(d, '%Y-%m-%d') AS first, strftime(last_day(d), '%Y-%m-%d') AS last FROM m""",
    ),
    "daily_windows": (
        days,
        "WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), d AS (SELECT unnest(range(0, b - a + 1))::INT AS k, a FROM s) SELECT k, strftime(a + k, '%Y-%m-%d') AS start, strftime(a + k, '%Y-%m-%d') AS \"end\" FROM d",
    ),
    "model_suite": (model_rows, None),
    "adjusted_contrasts": (adjusted_contrasts, None),
    "adjusted_controls": (adjusted_controls, None),
    "adjusted_sensitivities": (adjusted_sensitivities, None),
    "exchangeable_subgroups": (exchangeable_subgroups, None),
    "adjusted_bootstrap": (adjusted_bootstrap, None),
    "threshold_tests": (threshold_tests, None),
    "bootstrap_by_strata": (bootstrap, None),
    "narrative_permutation": (narrative_test, None),
}
