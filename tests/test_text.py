import pytest
from pyspark.sql import functions as F

from mentionlab.functions import text as t
from mentionlab.operators import agreement, corrections, lexicon, pages
from mentionlab.operators import similarity as sim
from mentionlab.operators.components import connected_components
from mentionlab.sources import harvest

#: A few makes with the contexts that the golden strings need.
CARS = lexicon.Lexicon(
    (
        lexicon.Entity("Tesla", "bev", ("Tesla",), ("Model 3", "Model Y", "Model S", "Cybertruck")),
        lexicon.Entity("Mercedes-Benz", "premium", ("Mercedes-Benz", "Mercedes", "Merc")),
        lexicon.Entity("Land Rover", "premium", ("Land Rover", "Range Rover")),
        lexicon.Entity("Toyota", "mainstream", ("Toyota",), ("HiLux",)),
        lexicon.Entity("Ford", "mainstream", ("Ford",), ("Ranger",)),
        lexicon.Entity("Kia", "mainstream", ("Kia",)),
        lexicon.Entity("MG", "mainstream", ("MG",)),
        lexicon.Entity("RAM", "mainstream", ("RAM",)),
        lexicon.Entity("Suzuki", "mainstream", ("Suzuki",), ("Swift",)),
        lexicon.Entity("BYD", "bev", ("BYD",), ("Shark",)),
    ),
    {
        "tesla": (r"\bnikola\s+tesla\b", r"\b\d+(\.\d+)?\s*tesla\b", r"\btesla\s+(shares?|stock)\b"),
        "ranger": (r"\b(park|army)\s+rangers?\b",),
        "kia": (r"\bkia\s+ora\b",),
        "mg": (r"\b\d+\s*mg\b",),
        "ram": (r"\bram\s+(raid|raider)\b",),
        "swift": (r"\btaylor\s+swift\b",),
        "shark": (r"\bshark\s+(attack|bite)\b",),
    },
)
#: Headlines with what they name, as expected.
GOLDEN = [
    ("Teslas recalled after Sydney crash", "Tesla", True), ("Merc driver charged after Perth crash", "Mercedes-Benz", True), ("Range Rover ploughs into cafe", "Land Rover", True),
    ("Model-Y bursts into flames in Chatswood carpark", "Tesla", True), ("HiLux ploughs into shopfront", "Toyota", True), ("Tesla’s driver dies", "Tesla", True), ("New models arrive", "Tesla", True),
    ("Teslarati reports", "Tesla", False), ("Fordham street crash", "Ford", False), ("Nikola Tesla museum plans unveiled", "Tesla", False), ("3 tesla MRI", "Tesla", False),
    ("Tesla shares tumble after recall", "Tesla", False), ("Park ranger finds car", "Ford", False), ("Kia Ora festival", "Kia", False), ("500 mg of morphine", "MG", False),
    ("Ram raid on shop", "RAM", False), ("Taylor Swift concert crash", "Suzuki", False), ("Shark attack closes beach", "BYD", False),
]


def test_golden_headlines(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(GOLDEN)] + [(99, None)], "i int, h string")
    got = {r.i: r.mentions for r in lexicon.find_mentions(df, "h", CARS).collect()}
    for i, (h, entity, named) in enumerate(GOLDEN):
        assert (entity in got[i]) == named, h
    assert got[99] == {}
    strict = {r.i: r.mentions for r in lexicon.find_mentions(df, "h", CARS, strict=True).collect()}
    assert "Tesla" not in strict[3] and "Tesla" in strict[0]


def test_word_class(spark):
    plain = lexicon.Lexicon((lexicon.Entity("Tesla", "", ("tesla",)),))
    cases = {"teslarati": False, "the teslas": True, "tesla's": True, "étesla": False, "_tesla": False, "tesla3": False, "٣tesla": False, "tesla-3": True}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: bool(r.m) for r in df.select("x", lexicon.mentions_column(F.col("x"), plain).alias("m")).collect()}
    assert got == cases
    assert lexicon.Matcher(plain).mentions("étesla")  # decomposed, the accent is no word character
    with pytest.raises(ValueError):
        lexicon.mentions_column(F.col("x"), CARS)


def test_single_separator_and_forbidden():
    single = lexicon.Lexicon((lexicon.Entity("Tesla", "", (), ("Model S",)),), separator="single")
    assert not lexicon.Matcher(single).mentions("new models") and lexicon.Matcher(single).mentions("a model-s")
    with pytest.raises(ValueError):
        lexicon.Lexicon((lexicon.Entity("Ford", "", (), ("Focus",)),), forbidden=("focus",))
    assert lexicon.leaks(t.EVENT_TERMS + t.OUTCOME_TERMS, CARS) == []
    assert lexicon.leaks(("hit by a ford",), CARS) == [("hit by a ford", "Ford")]


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_urls(spark):
    assert one(spark, t.canonical_url, "HTTPS://WWW.News.example/A/b/?utm_source=x&id=7&blank=&FBCLID=9#top") == "https://www.news.example/A/b?id=7"
    for url, want in (
        ("https://A.example/A/b//?id=7", "https://a.example/A/b?id=7"),
        ("http://a.example/x?q=a%20b+c&r=%C3%A9*~", "http://a.example/x?q=a+b+c&r=%C3%A9%2A~"),
        ("http://a.example/x?=v&n&y=1=2&z=", "http://a.example/x?=v&y=1%3D2"),
        ("http://a.example/x?p=100%&q=%zz", "http://a.example/x?p=100%25&q=%25zz"),
        ("http://a.example?UTM_x=1#f", "http://a.example"),
    ):
        assert one(spark, t.canonical_url, url) == want
    assert one(spark, t.canonical_url, "http://a.example/x/?utm_medium=y") == "http://a.example/x"
    assert one(spark, lambda u: t.slug_title(u, "trailing"), "https://a.example/some-headline-slug-20240101-p5eugr.html") == "some headline slug"
    assert one(spark, lambda u: t.slug_title(u, "numbered"), "https://a.example/grand-slam-c-13078812") == "grand slam"
    assert one(spark, lambda u: t.slug_title(u, "story"), "https://a.example/many-words/news-story/159d083e") == "many words"
    assert one(spark, lambda u: t.slug_title(u, "coded"), "https://a.example/news/article/rebecca-was/2kmh") == "rebecca was"
    dated = "https://a.example/news/2026-07-27/act-dash-cam/106963942?x=1"
    assert one(spark, lambda u: t.slug_title(u, "dated"), dated) == "act dash cam" and str(one(spark, t.url_date, dated)) == "2026-07-27"


def test_dates(spark):
    for x in ("20260102T030405Z", "20260102030405", "2026-01-02T03:04:05Z", "2026-01-02"):
        assert str(one(spark, t.publication_date, x)) == "2026-01-02"
    assert one(spark, t.publication_date, "2026-01-02 03:04:05") is None
    assert one(spark, t.publication_date, "soon") is None and one(spark, t.lastmod_date, "2026") is None


def test_sitemaps(spark):
    xml = "<urlset><url><loc> http://a.example/1 </loc><lastmod>2026-01-01</lastmod></url>\n<url>\n<loc>http://a.example/2</loc></url></urlset>"
    assert [(i.loc, i.lastmod) for i in one(spark, t.sitemap_items, xml)] == [("http://a.example/1", "2026-01-01"), ("http://a.example/2", None)]
    assert [i.loc for i in one(spark, t.sitemap_items, "<sitemap><loc>http://a.example/3</loc></sitemap>")] == ["http://a.example/3"]


def test_headlines_are_stripped(spark):
    strip = lambda b, h, s=None: spark.createDataFrame([(b, h, s)], "b string, h string, s string").select(t.strip_headlines(F.col("b"), F.col("h"), F.col("s"))).first()[0]
    assert "ploughs" not in strip("Car ploughs, into: cafe\nThe driver left.", "Car ploughs into cafe")
    assert strip("CRASH ON HIGHWAY\nTwo people hurt.", None) == "Two people hurt."
    assert strip("Two people hurt.", "") == "Two people hurt."


def test_html(spark):
    page = "<html><head><title>A &amp;amp; b</title><style>x{}</style></head><body><header><nav>menu<p>x</nav> more</header><p>One <b>two</b>\n three &eacute;</p><script>z('</p>')</script><!-- no -->four</body>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>" + "word " * 60)], "id int, html string")
    got = {r.id: (r.title, r.body) for r in pages.extracted(df).collect()}
    assert got[1] == ("A & b", "One\ntwo\nthree é\nfour") and got[2] == got[3] == ("", "") and len(got[4][1]) == 299
    kept = pages.extracted(df.withColumn("html", F.concat(F.lit("<title>t</title>"), "html"))).where(pages.substantial(F.col("title"), F.col("body")))
    assert [r.id for r in kept.collect()] == [4]


def test_html_in_odd_shapes(spark):
    cases = {
        "<nav>a<aside>b</nav>c</aside>d": ("", "d"),  # any end tag closes the innermost
        "</nav>x<nav>y<p>z": ("", "x"),  # one that stays open holds the rest
        "<script>if (a<b) '<nav>'</script>after": ("", "after"),
        "<!-- <nav> -->shown<!-- </p -->too": ("", "shown\ntoo"),
        "<title>One <b>two</b></title><title>three</title>body<header><title>no</title></header>": ("One two three", "body"),
        '<p data-x="a > b">3 < 5</p><NAV class=\'>\'>n</NAV>&nbsp;end&nbsp;': ("", "3 < 5\nend"),
        "<navigation>kept</navigation><footer/>gone</footer>kept too": ("", "kept\nkept too"),
        "&amp;lt; &#233; &#x41;": ("", "< é A"),
        "  <p>  \n </p> ": ("", ""),
        "<p>a</p>" + "<nav><aside><footer>x</footer></aside></nav>" * 40 + "<p>b</p>": ("", "a\nb"),
        "<div>" * 3000 + "deep" + "</div>" * 3000: ("", "deep"),
        "<nav>" + "word " * 200_000 + "</nav>" + "text " * 200_000: ("", ("text " * 200_000).strip()),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, html string")
    got = {r.id: (r.title, r.body) for r in pages.extracted(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert "Python" not in pages.extracted(df)._jdf.queryExecution().toString()
    more = spark.createDataFrame([(1, "&copy 2020 &hellip; &fjlig; &#150; &unknown; AT&T"), (2, "&eacute;")], "id int, html string")
    assert {r.id: r.body for r in pages.extracted(more, html5=True).collect()} == {1: "© 2020 … fj – &unknown; AT&T", 2: "é"}


def test_narrative(spark):
    for x, want in (("Car ploughs into shop", True), ("LOST CONTROL of ute", True), ("ute rolled", True), ("trolled online", False), ("drove into the pub", True), (None, False), ("mounts kerb", True)):
        assert one(spark, t.narrative, x) == want


def test_corrections_take_any_columns(spark):
    """Columns that have the names of helpers or of the other side."""
    rows = spark.createDataFrame([(1, 1, 0, None, "r"), (2, 2, 1, "x", "s"), (3, 3, 1, "y", "t")], "article_id long, incident_id long, eligible int, entity string, reason string")
    rows = rows.selectExpr("*", "9 AS source", "8 AS article", "7 AS _id", "6 AS _d", "5 AS _key", "4 AS _n", "3 AS _day", "2 AS target")
    m = spark.createDataFrame([(1, 2), (3, 3), (2, 77)], "source long, target long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "incident_id long")
    assert [r.incident_id for r in corrections.merge(rows, m, ids).orderBy("article_id").collect()] == [2, 2, 3]
    assert [r.incident_id for r in corrections.split(rows, spark.createDataFrame([(2, 50)], "article long, target long")).orderBy("article_id").collect()] == [1, 50, 3]
    d = spark.createDataFrame([(1, "accept", "z", None)], "incident_id long, verdict string, entity string, why string")
    assert corrections.adjudicate(rows, d).where("incident_id = 1").first().entity == "z"
    assert corrections.exclude(rows, rows.where("article_id = 2").select("article_id")).agg(F.sum("excluded")).first()[0] == 1
    assert corrections.insert_ignore(rows, None, "incident_id", ["article_id"]).columns == rows.columns
    assert corrections.latest(rows, ["incident_id"], ["article_id"]).count() == 3


def test_merges_and_splits_of_incidents(spark):
    inc = spark.createDataFrame([(1, "d", 1, "a", None, 0, "x", None), (2, "d", 1, "b", None, 0, "x", None), (3, "d", 1, "c", None, 1, "x", None)], "incident_id long, day string, eligible int, entity string, second string, multi int, coded_by string, reason string")
    merged = {r.incident_id: r for r in corrections.merged_incidents(inc, spark.createDataFrame([(1, 2, "q"), (3, 3, None), (9, 2, None), (3, 99, None)], "source long, target long, second string")).collect()}
    assert (merged[1].eligible, merged[1].coded_by, merged[1].reason) == (0, corrections.BY_HAND, "merged into 2")
    assert (merged[2].eligible, merged[2].second, merged[3].eligible, merged[3].reason) == (1, "q", 1, None)
    s = spark.createDataFrame([(3, 30, "e", "n", "m", True), (3, 2, "e", "n", None, True), (8, 31, "e", None, None, False)], "source long, target long, day string, entity string, second string, eligible boolean")
    got = {r.incident_id: r for r in corrections.split_incidents(inc, s).collect()}
    assert set(got) == {1, 2, 3, 30}
    assert (got[30].eligible, got[30].entity, got[30].multi, got[30].coded_by) == (1, "n", 1, corrections.BY_HAND)
    assert (got[3].eligible, got[3].entity, got[3].multi, got[3].coded_by) == (0, None, 0, corrections.RECODE) and got[1].coded_by == "x"


def test_rare_links_connect_what_rare_pairs_connect(spark):
    import random

    rng = random.Random(2)
    docs = [(i, rng.randrange(12), [f"t{rng.randrange(40)}" for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc long, band int, w array<string>")
    counts = sim.token_counts(df.withColumnRenamed("doc", "d"), "d", F.col("w"))
    band = df.select("doc", "band")
    for days in (3, None):
        both = [{r.node: r.component for r in connected_components(f(counts, band, 5000, days=days).select("a", "b")).collect()} for f in (sim.rare_pairs, sim.rare_links)]
        assert both[0] == both[1] and both[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200), (50, 1), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 1, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_against_all_pairs(spark):
    texts = ["red bird sings loudly", "red bird sings loudly", "red bird sings", "blue fish swims", "blue fish swims deep", "", "lonely words", "red bird sings loudly"]
    rows = [(i, x, None if i == 6 else i % 3) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc long, text string, day int")
    tok = t.tokenise(F.col("text"), [])
    got = {r.doc: r.cluster for r in sim.clusters(df, "doc", tok, F.col("day"), rare=False).collect()}
    counts = sim.token_counts(df, "doc", tok)
    w = {}
    for r in sim.tfidf(counts, df.count()).collect():
        w.setdefault(r.doc, {})[r.token] = r.w
    up = {i: i for i in range(len(texts))}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in w:
        for j in w:
            if i < j and None not in (rows[i][2], rows[j][2]) and sum(v * w[j].get(k, 0) for k, v in w[i].items()) >= sim.THETA:
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in up}


def test_corrections(spark):
    inc_ = spark.createDataFrame([("1", 0, None, "open"), ("2", 1, "a", None), ("3", 0, None, "open")], "incident_id string, eligible int, entity string, reason string")
    d = spark.createDataFrame([("1", "accept", "b", None), ("2", "reject", None, "dup"), ("9", "accept", None, None)], "incident_id string, verdict string, entity string, why string")
    assert sorted(tuple(r) for r in corrections.adjudicate(inc_, d).collect()) == [("1", 1, "b", None), ("2", 0, "a", "dup"), ("3", 0, None, "open")]
    assert {r.status: r.decisions for r in corrections.decision_stats(inc_, d).collect()} == {"accept": 1, "reject": 1, "unknown": 1}


def test_agreement(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    r = agreement.kappa(pairs, "x", "y").first()
    assert r.exact == 0.75 and r.kappa == pytest.approx(0.5)
    assert agreement.kappa(spark.createDataFrame([("a", "a")], "x string, y string"), "x", "y").first().kappa is None
    gold = spark.createDataFrame([("1", "T"), ("2", "T"), ("3", "F"), ("4", "F")], "id string, v string")
    machine = spark.createDataFrame([("1", "T"), ("2", "T"), ("3", "F")], "id string, v string")
    got = agreement.recall(gold, machine, "id", "v", F.col("v") == "T").collect()
    assert {r.entity: r.recall for r in got} == {"T": 1.0, "F": 0.5} and got[0].differential == pytest.approx(0.5)


def test_landed_files(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "s").mkdir()
    with gzip.open(tmp_path / "s" / "sitemap260102.xml.gz", "wt") as f:
        f.write("<url><loc>http://www.a.example/car-crash-kills-two</loc><lastmod>2026-01-03T00:00:00Z</lastmod></url><url><loc>http://a.example/recipe-of-the-day</loc></url>")
    items = harvest.sitemaps(spark, str(tmp_path / "s"))
    assert {str(r.day) for r in items.collect()} == {"2026-01-02"}
    rows = harvest.candidates(items, "loc", "trailing", t.EVENT_TERMS, "lastmod").collect()
    assert [(r.title_at_crawl, r.domain, str(r.day)) for r in rows] == [("car crash kills two", "a.example", "2026-01-03")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"articles": [{"url": "u", "title": "t"}]}))
    (tmp_path / "j" / "b.json").write_text("<html>slow down</html>")
    got = {r.file[-6:]: (r.n_returned, r.ok) for r in harvest.search_answers(spark, str(tmp_path / "j")).collect()}
    assert got == {"a.json": (1, True), "b.json": (0, False)}
    assert harvest.search_strings(("a", "b c", "d"), 2) == ['(a OR "b c")', "(d)"]
