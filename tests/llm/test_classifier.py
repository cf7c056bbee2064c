import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlab.llm import classifier as cl


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = ("Ab, cd! É1 " * 300 + "x" * 500).encode()
    want = cl.features(text)
    monkeypatch.setattr(cl, "CHUNK", 64)
    got = cl.features(text)
    words = lambda f: set(f[f < 1 << cl.HASH_BITS].tolist())
    assert words(cl.features(b"ab cd \xc3\x891")) == words(cl.features("AB--cd;É1!".encode()))
    assert words(want) >= words(cl.features(b"ab cd")) and words(got) >= words(cl.features(b"ab cd"))
    assert len(cl.features(b"")) == cl.STYLE


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on two thirds of the labels, judged on the rest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    got = cl.classify(docs, labels.where(~held), F.col("source"), F.col("lang")).join(labels.where(held), "doc_id").collect()
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.85 * len(got)


def test_sites_against_plain_formulas(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{h}" if h else None, f"p{p}", float(q), 0.0) for h in range(6) for p in range(3) for q in (rng.random(5 + 7 * h) < 0.2 + 0.1 * h)]
    df = spark.createDataFrame(rows, "host string, path string, p_quality double, p_toxic double")
    got = {(r.host, r.path): r for r in cl.sites(df).collect()}
    hosts = {}
    for h, _, q, _ in rows:
        hosts.setdefault(h, []).append(q)
    mean = sum(map(sum, hosts.values())) / len(rows)

    def weight(groups):  # (n, s, centre)
        n = np.array([g[0] for g in groups], float)
        r = np.array([g[1] for g in groups]) / n
        c = np.array([g[2] for g in groups])
        between = (n * (r - c) ** 2).sum() / (len(n) - 1)
        within = (n * r * (1 - r)).sum() / (n.sum() - len(n))
        size = (n.sum() - (n * n).sum() / n.sum()) / (len(n) - 1)
        share = (between - within) / (between + (size - 1) * within)
        return min(1e6, max(1.0, (1 - share) / share)) if share > 1e-6 else 1e6

    want = weight([(len(v), sum(v), mean) for v in hosts.values()])
    for (h, p), r in got.items():
        assert r.mean_quality == pytest.approx(mean)
        assert r.host_weight_quality == pytest.approx(want)
        assert (r.n, r.s_quality) == (sum(x[:2] == (h, p) for x in rows), sum(x[2] for x in rows if x[:2] == (h, p)))


def test_sparse_sites_shrink(spark):
    """A site of one document is judged by the global rate, a bad site of many pulls its documents down."""
    rows = [(i, "plain words here", "big" if i < 400 else "bad" if i < 800 else f"s{i}", "p") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(not 400 <= i < 790), 0) for i in range(0, 900) if i % 10], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cl.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(got) == 900
    assert got[10].p_quality > 0.9 and got[410].p_quality < 0.1
    assert abs(got[810].site_quality - got[820].site_quality) < 0.02
    assert got[410].site_quality < got[810].site_quality < got[10].site_quality


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (3, "w " * 100000, None, "b"), (3, "w " * 100000, None, "b"), (None, "x", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS host", "2 AS n", "3 AS p_quality")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (3, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(9, "http://x.example/de/3?ref=1", "h"), (8, "https://y.example/a/b/3.html", "h"), (7, None, None), (6, "nonsense", "")], "page_id long, url string, html string")
    got = cl.classify(docs, labels, F.col("source"), F.col("lang"), places=cl.addresses(pages)).collect()
    assert sorted((r.doc_id or 0, r.host or "", r.path or "") for r in got) == [(0, "a", "b"), (1, "", ""), (2, "a", ""), (3, "y.example", "/a/b"), (3, "y.example", "/a/b")]
    assert all(0 <= r.p_quality <= 1 and not math.isnan(r.p_toxic) for r in got)
    assert cl.classify(docs.limit(0), labels.limit(0), F.col("source"), F.col("lang")).count() == 0
    assert cl.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == 5


def test_sample_is_bounded(spark):
    """Most rows repeat one id, some the whole row: still at most per_class rows of each combination."""
    rows = [(1, f"text of hot id {i}") for i in range(6000)] + [(2, "same")] * 4000 + [(i, f"doc {i}") for i in range(3, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1, 2000)], "doc_id long, quality int, toxic int")
    few, sizes = cl.sample(docs, labels, per_class=100)
    got = few.collect()
    of = [(r.quality, r.toxic) for r in got]
    assert sizes[1, 0] == 800 and len(set((r.quality, r.toxic, r.key) for r in got)) == len(got)
    assert all(0 < of.count(g) <= 100 for g in sizes) and of.count((0, 0)) >= 60


def squash(x):
    return 1 / (1 + math.exp(-x))


def logit(p):
    p = min(1 - 1e-9, max(1e-9, p))
    return math.log(p / (1 - p))


def prior(groups):
    """Weight of the prior from (n, sum, centre) of groups."""
    n, s, c = (np.array(x, float) for x in zip(*groups))
    r, g, total = s / n, len(n), n.sum()
    between = (n * (r - c) ** 2).sum() / max(1, g - 1)
    within = (n * r * (1 - r)).sum() / max(1, total - g)
    size = (total - (n * n).sum() / total) / max(1, g - 1)
    share = (between - within) / max(1e-12, between + (size - 1) * within)
    return min(1e6, max(1.0, (1 - share) / share if share > 1e-6 else 1e6))


def test_query_against_plain_posteriors(spark, sf_dir):
    """The whole query: sites from URLs, group sums, prior weights and each document's posterior, in plain Python."""
    import re

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels", "pages")}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    model = cl.fit(frames["documents"], frames["labels"])
    place = {}
    for p in sorted(tables["pages"], key=lambda p: p.page_id):
        m = re.search(r"/(\d+)(\.html|/)?([?#].*)?$", p.url or "")
        h = re.match(r"[a-z]+://([^/?#]+)", p.url or "")
        q = re.match(r"[a-z]+://[^/?#]+(/[^?#]*)/\d+", p.url or "")
        if m and h:
            place.setdefault(int(m[1]), (h[1], q[1] if q else ""))
    known = {}
    for r in tables["labels"]:
        a = known.get(r.doc_id, (1, 0))
        known[r.doc_id] = (min(a[0], int(r.quality > 0)), max(a[1], int(r.toxic > 0)))
    docs = {}
    for d in tables["documents"]:
        own = model.logits((d.text or "").encode())
        docs[d.doc_id] = (*place.get(d.doc_id, (d.source, d.lang)), own)
    want = {}
    for k in range(2):
        value = {d: float(known[d][k]) if d in known else squash(x[2][k]) for d, x in docs.items()}
        paths, hosts = {}, {}
        for d, (h, p, _) in docs.items():
            for at, key in ((paths, (h, p)), (hosts, h)):
                n, s = at.get(key, (0, 0.0))
                at[key] = (n + 1, s + value[d])
        mean = sum(value.values()) / len(value)
        wide = prior([(n, s, mean) for n, s in hosts.values()])
        narrow = prior([(n, s, hosts[h][1] / hosts[h][0]) for (h, _), (n, s) in paths.items()])
        for d, (h, p, x) in docs.items():
            above = (hosts[h][1] - value[d] + wide * mean) / (hosts[h][0] - 1 + wide)
            rate = min(1.0, max(0.0, (paths[h, p][1] - value[d] + narrow * above) / (paths[h, p][0] - 1 + narrow)))
            want.setdefault(d, []).append((squash(x[k]), rate, squash(x[k] - logit(mean) + logit(rate))))
    got = cl.op9_classifier(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        (dq, sq, pq), (dt, st, pt) = want[r.doc_id]
        assert (r.host, r.path) == docs[r.doc_id][:2]
        assert (r.doc_quality, r.site_quality, r.p_quality, r.doc_toxic, r.site_toxic, r.p_toxic) == pytest.approx((dq, sq, pq, dt, st, pt), abs=1e-6)
        assert r.kept == (r.p_quality >= 0.5 > r.p_toxic)


def test_features_against_plain_words():
    """A text's words are its runs of ASCII letters, digits and bytes beyond; equal words, equal numbers."""
    import re

    texts = ["One two, two THREE!", "É1 x_y 42|#*", "", "a" * 5000 + " b"]
    numbers = {}
    for t in texts:
        f = cl.features(t.encode())
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()))
        assert (f < 1 << cl.HASH_BITS).sum() == len(words)
        for w in words:
            (n,) = [x for x in cl.features(w) if x < 1 << cl.HASH_BITS]
            assert n in f and numbers.setdefault(w, n) == n


def plain_fit(texts, y, weight, rates):
    """The fit with one dense row for each text: words that depend on the label, Adam on the weighted log-loss."""
    seen = [set(cl.features(t).tolist()) for t in texts]
    logits = []
    for k in range(2):
        r, n, total = y[:, k].mean(), {}, {}
        for f, label in zip(seen, y[:, k], strict=True):
            for x in f:
                n[x], total[x] = n.get(x, 0) + 1, total.get(x, 0) + label
        chi = lambda x: (total[x] - n[x] * r) ** 2 / max(n[x] * r * (1 - r), 1e-9)  # noqa: B023, E731
        used = sorted(x for x in n if n[x] >= cl.MIN_DOCS and (x >= 1 << cl.HASH_BITS or chi(x) >= cl.MIN_CHI))
        z = np.array([[x in f for x in used] for f in seen], float)
        share = weight / weight.sum()
        w = np.zeros(len(used) + 1)
        w[-1] = math.log(rates[k] / (1 - rates[k]))
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for t in range(1, cl.STEPS + 1):
            error = (1 / (1 + np.exp(-(z @ w[:-1] + w[-1]))) - y[:, k]) * share
            g = np.append(z.T @ error + cl.RIDGE / 100 * w[:-1], error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (1 - t / (cl.STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        logits.append(np.clip(z @ w[:-1] + w[-1], -cl.MAX_LOGIT, cl.MAX_LOGIT))
    return np.array(logits).T


def test_fit_against_a_plain_one(spark, sf_dir):
    """All labelled documents of the table are in the sample; their logits are those of dense matrices."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = cl.known_labels(labels).where("quality is not null and toxic is not null")
    rows = docs.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality", "toxic").orderBy("doc_id").collect()
    sizes = {}
    for r in known.collect():
        sizes[r.quality, r.toxic] = sizes.get((r.quality, r.toxic), 0) + 1
    of = [(r.quality, r.toxic) for r in rows]
    n = sum(sizes.values())
    rates = [(sum(c for g, c in sizes.items() if g[k]) + 1) / (n + 2) for k in range(2)]
    texts = [(r.text or "").encode() for r in rows]
    want = plain_fit(texts, np.array(of, float), np.array([sizes[g] / of.count(g) for g in of]), rates)
    model = cl.fit(docs, labels)
    assert np.abs(np.array([model.logits(t) for t in texts]) - want).max() < 1e-3
