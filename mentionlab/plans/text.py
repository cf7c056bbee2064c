"""Queries over text, URLs, dates and similarity on the test tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import lexicon as lx
from mentionlab.operators import pages
from mentionlab.operators import similarity as sim
from mentionlab.session import table
from mentionlab.sources import harvest

#: A lexicon for part names: entities are kinds of goods, models qualify one of them.
GOODS = lx.Lexicon((lx.Entity("Widget", "turned", ("widget", "gizmo")), lx.Entity("Bolt", "turned", ("bolt",), ("hot",)), lx.Entity("Gear", "cut", ("gear", "cog"), ("small", "large"))))
#: A lexicon for documents.
WORDS = lx.Lexicon((lx.Entity("The", "en", ("the",), ("of",)), lx.Entity("Die", "de", ("die", "der"), ("und",)), lx.Entity("Que", "fr", ("que",))))
STOP = t.stop_words(t.EVENT_TERMS, t.OUTCOME_TERMS)
_W = r"[\p{L}\p{N}_]"


def _sql_hit(col, tokens):
    return f"regexp_matches({col}, '(^|[^{_W[1:-1]}])({'|'.join(re.escape(x) for x in tokens)})(''s|s''|s)?([^{_W[1:-1]}]|$)')"


def _list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def lexicon_mentions(spark, sf):
    """Entities named in part names, by the JVM matcher."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return p.select("p_partkey", F.array_join(lx.mentions_column(F.col("name"), GOODS), ",").alias("named"), F.array_join(lx.mentions_column(F.col("name"), GOODS, strict=True), ",").alias("named_strict"))


def lexicon_matcher(spark, sf):
    """The same entities from the Arrow matcher, with the tokens that were found."""
    found = lx.find_mentions(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", GOODS)
    return found.select("p_partkey", F.array_join(F.map_keys("mentions"), ",").alias("named"), F.array_join(F.flatten(F.map_values("mentions")), ",").alias("tokens"))


def _goods_sql(strict):
    rows = [(e.name, e.aliases if strict else (*e.aliases, *e.models)) for e in GOODS.entities]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_sql_hit('lower(p_name)', tok)} THEN '{n}' END" for n, tok in rows) + ")"


def first_position(spark, sf):
    """Where documents name the first entity: their first line is the headline."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    says = lambda x: F.lower(x).rlike(rf"(?<!{t.WORD})(the|of)('s|s'|s)?(?!{t.WORD})")
    head, body = F.regexp_extract("text", r"^([^\n]*)", 1), F.regexp_replace("text", r"^[^\n]*\n?", "")
    return d.select("doc_id", t.first_mention(says, head, F.lit(None).cast("string"), F.when(F.col("text").isNotNull(), body)).alias("position"))


def html_text(spark, sf):
    """Title and body of each page, and whether the extraction is kept."""
    p = pages.extracted(table(spark, sf, "pages").select("page_id", "html"))
    body = F.col("body")
    return p.select("page_id", "title", F.length(body).cast("long").alias("chars"), F.sha2(body, 256).alias("text_sha256"), pages.substantial(F.col("title"), body).alias("kept"))


def _resolved(x):
    for name, char in (("amp", "&"), ("copy", "©"), ("middot", "·"), ("quot", '"')):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


HTML_SQL = (
    "WITH b0 AS (SELECT page_id, html, regexp_replace(html, '(?is)<!--.*?-->', chr(1), 'g') AS x FROM pages), "
    + ", ".join(f"b{i + 1} AS (SELECT page_id, html, regexp_replace(x, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g') AS x FROM b{i})" for i, tag in enumerate((*pages.SKIPPED, "title")))
    + f""", r AS (SELECT page_id, html, list_transform(string_split(regexp_replace(x, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))) AS runs FROM b8),
    f AS (SELECT page_id, {_resolved("array_to_string(list_filter(runs, lambda s: s <> ''), chr(10))")} AS x, {_resolved("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title FROM r)
    SELECT page_id, title, length(x)::BIGINT AS chars, sha256(x) AS text_sha256, title <> '' AND length(x) >= 200 AS kept FROM f"""
)

#: Ends that URLs are tried with: slashes, encoded, blank, unnamed and tracking parameters, a stray per cent sign, a fragment.
ENDS = ("", "/?ID=7&q=a%20b+c%7E*&utm_source=x&empty=&=v", "//?x=1%zz&Fbclid=3&y=%C3%A9=1&novalue#top", "/a/b/?icid=1")


def _tried(spark, sf):
    """Pages' URLs as they are, and cut before their query with each of the ends."""
    p = table(spark, sf, "pages").select("page_id", "url")
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    return p.select("page_id", F.posexplode(F.array(F.col("url"), *[F.concat(bare, F.lit(e)) for e in ENDS[1:]])).alias("variant", "url"))


def urls(spark, sf):
    p = _tried(spark, sf)
    c = t.canonical_url(F.col("url"))
    slugs = [t.slug_title(F.col("url"), k).alias(f"slug_{k}") for k in t.SLUGS]
    return p.select("page_id", "variant", c.alias("canonical"), t.url_hash(c).alias("url_hash"), t.host(F.col("url")).alias("host"), *slugs)


def _decoded(x):
    """A per cent sign that begins no code stands for itself."""
    return f"url_decode(array_to_string(list_transform(string_split(replace({x}, '+', ' '), '%'), lambda y, i: CASE WHEN i > 1 AND NOT regexp_matches(y, '^[0-9A-Fa-f]{{2}}') THEN '25' || y ELSE y END), '%'))"


def canon_sql(source="SELECT page_id, url FROM pages", keys="page_id"):
    """CTEs that end in u(keys, url, canonical)."""
    return rf"""c AS (SELECT {keys}, url, regexp_extract(url, '(?s)^([^#]*)', 1) AS bare FROM ({source}) AS raw),
b AS (SELECT *, regexp_extract(bare, '(?s)^[^?]*\?(.*)$', 1) AS q, regexp_extract(bare, '^([^?]*)', 1) AS base FROM c),
k AS (SELECT *, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) AS start, rtrim(regexp_extract(base, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1), '/') AS path,
  list_filter(string_split(q, '&'), lambda p: regexp_matches(p, '(?s)^[^=]*=.+')) AS parts FROM b),
d AS (SELECT *, list_transform(parts, lambda p: {{'k': {_decoded("p[1:strpos(p, '=') - 1]")}, 'v': {_decoded("p[strpos(p, '=') + 1:]")}}}) AS pairs FROM k),
e AS (SELECT *, array_to_string(list_transform(list_filter(pairs, lambda x: NOT regexp_matches(lower(x.k), '^(utm_|fbclid|gclid|cmpid|icid|ito)')),
  lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS kept FROM d),
u AS (SELECT {keys}, url, start || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM e)""".replace("\\\\", "\\")


CANON = canon_sql()
_CUT = "regexp_extract(url, '^([^?#]*)', 1)"
TRIED = canon_sql("SELECT page_id, 0 AS variant, url FROM pages" + "".join(f" UNION ALL SELECT page_id, {k}, {_CUT} || '{e}' FROM pages" for k, e in enumerate(ENDS) if k), "page_id, variant")
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


def _slug(kind):
    pattern, cut = t.SLUGS[kind]
    found = f"regexp_extract(regexp_extract(url, '^([^?]*)', 1), '{pattern}', 1)"
    found = f"regexp_replace({found}, '{cut}', '')" if cut else found
    return f"replace({found}, '-', ' ') AS slug_{kind}"


URLS_SQL = f"WITH {TRIED} SELECT page_id, variant, canonical, substr(sha1(canonical), 1, 16) AS url_hash, {HOST} AS host, {', '.join(_slug(k) for k in t.SLUGS)} FROM u"


def url_days(spark, sf):
    """Pages under the dated grammar: the day in their URL, and whether it lies in a window."""
    day = F.lpad((F.col("page_id") % 14 + 1).cast("string"), 2, "0")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://n.example/news/2025-"), day, F.lit("-10/some-words/"), F.col("page_id").cast("string")).alias("url"))
    day = t.url_date(F.col("url"))
    return p.select("page_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.coalesce(day.between("2025-03-10", "2025-09-09"), F.lit(False)).alias("inside"))


OUTLETS = (("tionsh.example.net", "Alpha"), ("tionble.example.com", "Beta"), ("example.org", "Gamma"), ("example.com", "Delta"))


def outlet_match(spark, sf):
    """Pages by outlet, those of no listed domain under the default."""
    p = table(spark, sf, "pages").select("page_id", t.host(F.col("url")).alias("host"))
    outlets = spark.createDataFrame([(d, b, k) for k, (d, b) in enumerate(OUTLETS)], "domain string, brand string, place int")
    return harvest.match_outlets(p, "host", outlets, default="unlisted").select("page_id", "brand")


def sitemap(spark, sf):
    """A sitemap made of the pages' URLs, one file for each host, read back."""
    p = table(spark, sf, "pages").where("url is not null").groupBy(t.host(F.col("url")).alias("host")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>2025-09-01T00:00:00Z</lastmod></url>")))), "\n"), F.lit("</urlset>")).alias("xml"))
    return p.select("host", F.explode(t.sitemap_items(F.col("xml"))).alias("i")).select("host", F.col("i.loc").alias("loc"), F.date_format(t.lastmod_date(F.col("i.lastmod")), "yyyy-MM-dd").alias("day"))


def dates(spark, sf):
    """Event times written in the four formats, in another, and not at all; parsed back."""
    e = table(spark, sf, "events").select("event_id", "ts")
    k = F.pmod("event_id", F.lit(6))
    formats = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
    shown = F.lit("no date")
    for i, f in enumerate(formats):
        shown = F.when(k == i, F.date_format("ts", f)).otherwise(shown)
    return e.select("event_id", F.date_format(t.publication_date(shown), "yyyy-MM-dd").alias("day"))


def titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.page_title(F.col("html")).alias("title"))


def _tokens(col):
    return t.tokenise(F.col(col), STOP)


TOKENS = f"""tok AS (SELECT page_id, unnest(list_filter(regexp_extract_all(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[a-z][a-z''\\-]+|\\d+'), lambda w: length(w) > 2 AND w NOT IN ({_list(STOP)}))) AS token FROM pages),
c AS (SELECT page_id AS doc, token, count(*) AS c FROM tok GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM c GROUP BY 1), nd AS (SELECT count(*) AS n FROM pages),
x AS (SELECT doc, token, df, c / sum(c) OVER (PARTITION BY doc) * ln((n + 1) / (df + 1)) AS x FROM c JOIN f USING (token), nd),
w AS (SELECT doc, token, df, x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY doc)) > 0 THEN sqrt(sum(x * x) OVER (PARTITION BY doc)) ELSE 1 END AS w FROM x)"""
COPIES = """, sg AS (SELECT doc, list(token || ' ' || c ORDER BY token) AS s FROM c GROUP BY 1), cp AS (SELECT doc, min(doc) OVER (PARTITION BY s, doc % 30) AS rep FROM sg),
rp AS (SELECT doc FROM cp WHERE doc = rep)"""
PAIRS = TOKENS + COPIES + """, p AS (SELECT a.doc AS a, b.doc AS b, round(sum(a.w * b.w), 9) AS cosine FROM (SELECT * FROM w SEMI JOIN rp USING (doc)) a JOIN (SELECT * FROM w SEMI JOIN rp USING (doc)) b ON a.token = b.token AND a.doc < b.doc AND abs(a.doc % 30 - b.doc % 30) <= 3 GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.35),
r AS (SELECT a.doc AS a, b.doc AS b, count(*) AS rare FROM (SELECT * FROM c SEMI JOIN rp USING (doc)) a JOIN f USING (token) JOIN (SELECT * FROM c SEMI JOIN rp USING (doc)) b ON a.token = b.token AND a.doc < b.doc AND abs(a.doc % 30 - b.doc % 30) <= 3, nd WHERE df <= greatest(2, floor(n * 0.002)) GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _weights(spark, sf):
    d = titles(spark, sf)
    return d, sim.token_counts(d, "page_id", _tokens("title"))


def tfidf_weights(spark, sf):
    d, counts = _weights(spark, sf)
    return sim.tfidf(counts, d.count()).select("doc", "token", F.round("w", 6).alias("w"))


def _days(d):
    return d.select(F.col("page_id").alias("doc"), F.pmod("page_id", F.lit(30)).cast("int").alias("band"))


def _reps(d, counts):
    days = _days(d)
    return days.join(sim.copies(counts, days).where("doc = rep").select("doc"), "doc", "left_semi")


def cosine_pairs(spark, sf):
    """Pairs between representatives of equal titles of a day; copy_groups has who belongs to whom."""
    d, counts = _weights(spark, sf)
    return sim.similar_pairs(sim.tfidf(counts, d.count()), _reps(d, counts)).withColumn("cosine", F.round("cosine", 6))


def rare_pairs(spark, sf):
    d, counts = _weights(spark, sf)
    return sim.rare_pairs(counts, _reps(d, counts), d.count())


def copy_groups(spark, sf):
    d, counts = _weights(spark, sf)
    return sim.copies(counts, _days(d))


def headline_clusters(spark, sf):
    return sim.clusters(titles(spark, sf), "page_id", _tokens("title"), F.pmod("page_id", F.lit(30)).cast("int"))


def syndication(spark, sf):
    """Copies within a host: the corpus-level idf, cosine of at least 0.85, components."""
    d = table(spark, sf, "pages").select("page_id", t.page_title(F.col("html")).alias("title"), t.host(F.col("url")).alias("host"))
    return sim.clusters(d, "page_id", _tokens("title"), F.col("host"), theta=0.85, days=None, rare=False)


_TOKEN_ARRAY = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''\\-]+|\\d+'), lambda w: length(w) > 2 AND w NOT IN ({_list(STOP)}))"

QUERIES = {
    "lexicon_mentions": (lexicon_mentions, f"SELECT p_partkey, {_goods_sql(False)} AS named, {_goods_sql(True)} AS named_strict FROM part"),
    "lexicon_matcher": (
        lexicon_matcher,
        f"SELECT p_partkey, {_goods_sql(False)} AS named, concat_ws(',', {', '.join(f'CASE WHEN {_sql_hit(chr(108) + 'ower(p_name)', [tok])} THEN {chr(39)}{tok}{chr(39)} END' for e in GOODS.entities for tok in (*e.aliases, *e.models))}) AS tokens FROM part",
    ),
    "canonical_entities": (
        lambda s, d: table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).select("word", lx.canonical(F.col("word"), GOODS).alias("entity")).groupBy("word", "entity").agg(F.count(F.lit(1)).alias("n")),
        "SELECT word, CASE WHEN word IN ('widget', 'gizmo') THEN 'Widget' WHEN word = 'bolt' THEN 'Bolt' WHEN word IN ('gear', 'cog') THEN 'Gear' END AS entity, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1, 2",
    ),
    "names_any_vs_index": (
        lambda s, d: table(s, d, "documents").select("lang", lx.mentions_column(F.lower(F.coalesce("text", F.lit(""))), WORDS).alias("m")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.size("m") > 0).alias("names_any"), F.count_if(F.array_contains("m", "Die")).alias("names_index")),
        f"WITH m AS (SELECT lang, lower(coalesce(text, '')) AS x FROM documents) SELECT lang, count(*) AS docs, count(*) FILTER ({_sql_hit('x', ('the', 'of', 'die', 'der', 'und', 'que'))}) AS names_any, count(*) FILTER ({_sql_hit('x', ('die', 'der', 'und'))}) AS names_index FROM m GROUP BY 1",
    ),
    "first_mention_position": (
        first_position,
        f"""WITH d AS (SELECT doc_id, text, lower(regexp_extract(text, '^([^\\n]*)', 1)) AS head, lower(regexp_replace(text, '^[^\\n]*\\n?', '')) AS body FROM documents),
        l AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')[1] AS para FROM d)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN {_sql_hit('head', ('the', 'of'))} THEN 'headline' WHEN coalesce({_sql_hit('para', ('the', 'of'))}, false) THEN 'first_paragraph' WHEN {_sql_hit('body', ('the', 'of'))} THEN 'later_body' ELSE 'absent' END AS position FROM l""",
    ),
    "keyword_filter": (
        lambda s, d: table(s, d, "documents").select("doc_id", t.keyword(F.col("text"), ("thing", "und der")).alias("event"), (t.keyword(F.col("text"), ("thing", "und der")) & t.keyword(F.col("text"), ("tion was", "die"))).alias("event_and_outcome")),
        "SELECT doc_id, coalesce(regexp_matches(text, '(?i)thing|und der'), false) AS event, coalesce(regexp_matches(text, '(?i)thing|und der') AND regexp_matches(text, '(?i)tion was|die'), false) AS event_and_outcome FROM documents",
    ),
    "narrative_regex": (
        lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("text").rlike(rf"(?i)(?<!{_W})(was|und|que)(?!{_W})")).alias("matching")),
        rf"SELECT source, count(*) AS docs, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(was|und|que)([^\p{{L}}\p{{N}}_]|$)')) AS matching FROM documents GROUP BY 1",
    ),
    "tokens_per_document": (
        lambda s, d: table(s, d, "documents").select("doc_id", t.tokenise(F.col("text"), STOP).alias("w")).select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("distinct_tokens")),
        f"WITH w AS (SELECT doc_id, {_TOKEN_ARRAY} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS distinct_tokens FROM w",
    ),
    "document_frequency": (
        lambda s, d: sim.frequencies(table(s, d, "documents"), t.tokenise(F.col("text"), STOP)),
        f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKEN_ARRAY}) AS token FROM documents) GROUP BY 1",
    ),
    "tfidf_weights": (tfidf_weights, f"WITH {TOKENS} SELECT doc, token, round(w, 6) AS w FROM w"),
    "cosine_pairs": (cosine_pairs, f"WITH {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM p"),
    "copy_groups": (copy_groups, f"WITH {TOKENS}{COPIES} SELECT doc, rep FROM cp"),
    "rare_token_pairs": (rare_pairs, f"WITH {PAIRS} SELECT a, b, rare FROM r"),
    "headline_clusters": (
        headline_clusters,
        f"""WITH RECURSIVE {PAIRS}, y AS (SELECT rep AS a, doc AS b FROM cp WHERE doc <> rep AND doc IN (SELECT doc FROM w WHERE w <> 0)),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, b FROM r UNION SELECT b, a FROM r UNION SELECT a, b FROM y UNION SELECT b, a FROM y),
        g(doc, reach) AS (SELECT page_id, page_id FROM pages UNION SELECT g.doc, e.b FROM g JOIN e ON g.reach = e.a),
        k AS (SELECT doc, min(reach) AS cluster FROM g GROUP BY 1) SELECT doc, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM k""",
    ),
    "syndication_groups": (
        syndication,
        f"""WITH RECURSIVE {TOKENS}, h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages),
        p AS (SELECT a.doc AS a, b.doc AS b FROM w a JOIN w b ON a.token = b.token AND a.doc < b.doc JOIN h x ON x.page_id = a.doc JOIN h y ON y.page_id = b.doc WHERE x.host = y.host GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.85),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), g(doc, reach) AS (SELECT page_id, page_id FROM pages UNION SELECT g.doc, e.b FROM g JOIN e ON g.reach = e.a),
        k AS (SELECT doc, min(reach) AS cluster FROM g GROUP BY 1) SELECT doc, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM k""",
    ),
    "canonical_urls": (urls, URLS_SQL),
    "url_days": (url_days, "SELECT page_id, strftime(day, '%Y-%m-%d') AS day, coalesce(day BETWEEN DATE '2025-03-10' AND DATE '2025-09-09', false) AS inside FROM (SELECT page_id, make_date(2025, CAST(page_id % 14 + 1 AS INT), 10) AS day FROM pages WHERE page_id % 14 < 12 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 14 >= 12) AS d"),
    "outlet_match": (
        outlet_match,
        f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), o(domain, brand, place) AS (VALUES {", ".join(f"('{d}', '{b}', {k})" for k, (d, b) in enumerate(OUTLETS))}),
        m AS (SELECT page_id, brand, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k FROM h LEFT JOIN o ON host = domain OR ends_with(host, '.' || domain))
        SELECT page_id, coalesce(brand, 'unlisted') AS brand FROM m WHERE k = 1""",
    ),
    "html_text": (html_text, HTML_SQL),
    "sitemap_explode": (sitemap, "SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host, url AS loc, '2025-09-01' AS day FROM pages WHERE url IS NOT NULL"),
    "multi_format_dates": (dates, "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events"),
}
