"""Operator 9: quality classifier with hierarchical empirical Bayes over sites.

Document evidence: logistic regressions on word presence (hashed) and binned style ratios, one for each label (quality,
toxic), fitted on a bounded sample of labelled documents and applied to every whole text.

Site evidence: for each label, hosts and paths get a Beta posterior of their rate. A host's prior is centred at the
global rate, a path's prior at its host's posterior mean; the priors' weights are estimated from the spread of the group
rates themselves (one-way analysis of variance), so sites of few documents stay near the level above them. Group sums
hold known labels where there are any and the classifier's probabilities elsewhere; they are plain grouped
aggregations, and a document's own share is taken out of its site's rate before the two are combined:

    logit P = document logit - logit(global rate) + logit(rate of its path without it)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import table, written

LABELS = ("quality", "toxic")
#: Labelled documents of each combination of labels that the fit uses at most.
PER_CLASS = 2000
HASH_BITS, BINS, MIN_DOCS, MIN_CHI = 18, 16, 3, 12.0
#: Ridge weight, steps of the fit, and bounds of the priors' weights.
RIDGE, STEPS, PRIOR_WEIGHT = 1e-3, 400, (1.0, 1e6)
#: Bound of a document's logit, and tables of sites that are sent to executors up to this many rows.
MAX_LOGIT, MAX_BROADCAST_SITES = 12.0, 20_000
CHUNK = 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.int8)  # 1: part of a word
_KIND[48:58] = _KIND[97:123] = _KIND[128:] = 1
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_B, CHUNK + 1), _powers(_BINV, CHUNK + 1)
#: Style ratios and their largest bins: symbols, digits, capitals, white space, non-ASCII, pipes, distinct
#: words, length, repeated lines, exclamation marks.
STYLE = 10
SIZE = (1 << HASH_BITS) + STYLE * BINS


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: its hashed words, and a bin for each style ratio."""
    found, n_words, counts = [], 0, np.zeros(256, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):  # cut where a word ends, if one ends at all
            while end > at and _KIND[_FOLD[text[end - 1]]]:
                end -= 1
            end = end if end > at else at + CHUNK
        raw = np.frombuffer(text[at:end], np.uint8)
        counts += np.bincount(raw, minlength=256)
        low = _FOLD[raw]
        inside = np.concatenate(([0], _KIND[low], [0]))
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _POW[: len(low)], dtype=np.uint64)))
        h = (total[stop] - total[start]) * _INV[start]
        h ^= h >> np.uint64(29)
        found.append(np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)))
        n_words += len(start)
        at = end
    words = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    n = max(1, len(text))
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    ratios = [
        8 * counts[list(b"#*$%&<>")].sum() / n, 8 * counts[48:58].sum() / n, counts[65:91].sum() / letters, 2 * counts[list(b" \t\n\r")].sum() / n,
        counts[128:].sum() / n, 16 * counts[124] / n, len(words) / max(1, n_words), np.log2(1 + n_words) / 16,
        1 - len(set(lines)) / max(1, len(lines)), 16 * counts[33] / n,
    ]
    bins = [(1 << HASH_BITS) + k * BINS + min(BINS - 1, int(r * BINS)) for k, r in enumerate(ratios)]
    return np.concatenate((words.astype(np.int64), bins))


class Model:
    """Weights of the features and a bias for each label; rates are those of all labelled documents."""

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rates: np.ndarray):
        self.rates = rates
        self.weights, self.bias = np.zeros((SIZE, len(LABELS)), np.float32), np.log(rates / (1 - rates))
        if not docs:
            return
        flat, all_rows = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        df = np.bincount(flat, minlength=SIZE)
        for k in range(len(LABELS)):
            if not 0 < y[:, k].sum() < len(y):
                continue
            r = y[:, k].mean()  # a word is used if the label depends on it (chi-square); style bins always are
            chi = (np.bincount(flat, y[all_rows, k], SIZE) - df * r) ** 2 / np.maximum(df * r * (1 - r), 1e-9)
            used = np.flatnonzero((df >= MIN_DOCS) & ((chi >= MIN_CHI) | (np.arange(SIZE) >= 1 << HASH_BITS)))
            number = np.full(SIZE, -1, np.int64)
            number[used] = np.arange(len(used))
            row, col = all_rows, number[flat]
            row, col = row[col >= 0], col[col >= 0]
            w, b, s = np.zeros(len(used)), self.bias[k], weight / weight.sum()
            m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
            for t in range(1, STEPS + 1):  # Adam on the whole sample
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(docs)) + b, -30, 30)))
                e = (p - y[:, k]) * s
                g = np.bincount(col, e[row], len(used)) + RIDGE / 100 * w
                gb = e.sum()
                m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                rate = 0.1 * (1 - t / (STEPS + 1))
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
            self.weights[used, k], self.bias[k] = w, b

    def logits(self, text: bytes) -> np.ndarray:
        return np.clip(self.weights[features(text)].sum(axis=0, dtype=np.float64) + self.bias, -MAX_LOGIT, MAX_LOGIT)


def known_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(label_id, quality, toxic) as 0/1: of repeated ids the least quality and the largest toxicity; null labels stay
    null, null ids say nothing."""
    return labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg((F.min("quality") > 0).cast("int").alias("quality"), (F.max("toxic") > 0).cast("int").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> tuple[DataFrame, dict]:
    """(quality, toxic, key, t): of each combination of labels at most per_class different labelled rows, those with the
    smallest digests of id and text; and the labels' numbers for each combination.

    Labels are thinned by the digest of their id before they are sent, and labelled rows by the digest of id and text
    before they meet: a row that is repeated counts once, an id with many texts is thinned like any rows.
    """
    known = known_labels(labels).where("quality is not null and toxic is not null").withColumn("digest", F.substring(F.md5(F.col("label_id").cast("string")), 1, 8))
    sizes = {(r.quality, r.toxic): r["count"] for r in known.groupBy("quality", "toxic").count().collect()}  # four rows

    def thinned(df: DataFrame, digest: str, counts: dict) -> DataFrame:
        """About twice per_class rows of each combination."""
        cut = F.lit("")
        for (q, t), c in counts.items():
            cut = F.when((F.col("quality") == q) & (F.col("toxic") == t), format(min(0xFFFFFFFF, int(2 * per_class / max(1, c) * 0xFFFFFFFF)), "08x")).otherwise(cut)
        return df.where(F.substring(digest, 1, 8) <= cut)

    few = written(thinned(known, "digest", sizes), "eb-labels")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(few), F.col("id") == F.col("label_id"))
    counts = {(r.quality, r.toxic): r["count"] for r in rows.groupBy("quality", "toxic").count().collect()}
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.md5(F.coalesce("t", F.lit(b"")))))
    some = thinned(rows.select("quality", "toxic", key.alias("key"), "t"), "key", counts)
    once = some.groupBy("quality", "toxic", "key").agg(F.first("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy("key"))
    return once.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank"), sizes


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """A model from sample()'s rows, weighted back to the combinations' true shares. What reaches the driver are numbers of
    features, 4 * per_class lists of at most SIZE."""
    few, sizes = sample(docs, labels, text, doc_id, per_class)
    n = sum(sizes.values())
    rates = np.array([(sum(c for g, c in sizes.items() if g[k]) + 1) / (n + 2) for k in range(len(LABELS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(t or b"").astype(np.int32) for t in b.column(3).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), found], names=["quality", "toxic", "key", "f"])

    got = few.mapInArrow(run, "quality int, toxic int, key string, f array<int>").toArrow().sort_by([("quality", "ascending"), ("toxic", "ascending"), ("key", "ascending")])
    of = list(zip(got.column("quality").to_pylist(), got.column("toxic").to_pylist()))
    y = np.array(of, np.float64).reshape(-1, len(LABELS))
    seen = {g: max(1, of.count(g)) for g in sizes}
    return Model([x.values.to_numpy().astype(np.int64) for x in got.column("f")], y, np.array([sizes[g] / seen[g] for g in of]), rates)


def evidence(docs: DataFrame, model: Model, host: Column, path: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, host, path, logit_quality, logit_toxic) of every row; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "host", "path", *(f"logit_{k}" for k in LABELS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([shared.value.logits(t or b"") for t in b.column(3).to_pylist()]).reshape(-1, len(LABELS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(LABELS)))], names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {kind}, host string, path string, " + ", ".join(f"logit_{k} double" for k in LABELS)
    )


def prior_weight(groups: DataFrame, n: str, s: str, centre: Column) -> Column:
    """Weight of a Beta prior at `centre` for groups of n rows with sums s, by the analysis of variance of their rates:
    an aggregate expression; where rates spread no more than chance it is the upper bound."""
    r, c = F.col(s) / F.col(n), F.col(n)
    g, total = F.count(F.lit(1)), F.sum(c)
    between = F.sum(c * (r - centre) * (r - centre)) / F.greatest(g - 1, F.lit(1))
    within = F.sum(c * r * (1 - r)) / F.greatest(total - g, F.lit(1))
    size = (total - F.sum(c * c) / total) / F.greatest(g - 1, F.lit(1))
    share = (between - within) / F.greatest(between + (size - 1) * within, F.lit(1e-12))
    return F.least(F.lit(PRIOR_WEIGHT[1]), F.greatest(F.lit(PRIOR_WEIGHT[0]), F.when(share > 1e-6, (1 - share) / share).otherwise(PRIOR_WEIGHT[1])))


def _squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(q / (1 - q))


def sites(rows: DataFrame) -> DataFrame:
    """rows(host, path, p_quality, p_toxic) -> (host, path, n, and for each label: sum, rate of host's prior, prior weight).

    Every level is a grouped aggregation with partial sums; the global level is one row, joined as constants.
    """
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p_{k}").alias(f"s_{k}") for k in LABELS])
    paths = written(paths, "eb-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in LABELS]), "eb-hosts")
    top = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in LABELS]).first()
    mean = {k: (top[f"s_{k}"] / top["n"] if top["n"] else 0.5) for k in LABELS}
    weight = hosts.agg(*[prior_weight(hosts, "n", f"s_{k}", F.lit(mean[k])).alias(k) for k in LABELS]).first()
    of_host = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), *[F.col(f"s_{k}").alias(f"host_s_{k}") for k in LABELS])
    both = paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    inner = both.agg(*[prior_weight(both, "n", f"s_{k}", F.col(f"host_s_{k}") / F.col("host_n")).alias(k) for k in LABELS]).first()
    for k in LABELS:
        both = both.withColumn(f"mean_{k}", F.lit(float(mean[k]))).withColumn(f"host_weight_{k}", F.lit(float(weight[k] or PRIOR_WEIGHT[1]))).withColumn(f"path_weight_{k}", F.lit(float(inner[k] or PRIOR_WEIGHT[1])))
    return both


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS, places: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, host, path, doc_quality and doc_toxic (classifier alone), site_quality and
    site_toxic (posterior mean of its path without the row), p_quality, p_toxic, kept (p_quality >= 0.5 > p_toxic).

    places(page_doc, page_host, page_path), one row for each id, gives host and path where it names a document; it is
    joined after the texts are scored. Null host or path is a site of its own; null text is judged as an empty one. Without
    labels, or with one class only, a label's classifier gives its global rate. Repeated rows are judged each. An empty
    table gives an empty result. Other columns of docs are not looked at.
    """
    model = fit(docs, labels, text, doc_id, per_class)
    scored = written(evidence(docs, model, host, path, text, doc_id), "eb-evidence")
    if places is not None:
        scored = scored.join(places, F.col("doc_id") == F.col("page_doc"), "left")
        there = F.col("page_host").isNotNull()
        scored = scored.withColumn("path", F.when(there, F.col("page_path")).otherwise(F.col("path"))).withColumn("host", F.coalesce("page_host", "host"))
    for k in LABELS:
        scored = scored.withColumn(f"doc_{k}", _squash(F.col(f"logit_{k}")))
    known = known_labels(labels).select("label_id", *[F.col(k).alias(f"known_{k}") for k in LABELS])
    joined = scored.join(known, F.col("doc_id") == F.col("label_id"), "left")
    for k in LABELS:
        joined = joined.withColumn(f"p_{k}", F.coalesce(F.col(f"known_{k}").cast("double"), F.col(f"doc_{k}")))
    rows = written(joined.select("doc_id", "host", "path", *[f"{p}_{k}" for p in ("logit", "doc", "p") for k in LABELS]), "eb-rows")
    site = written(sites(rows).withColumnsRenamed({"host": "h", "path": "q", **{f"s_{k}": f"sum_{k}" for k in LABELS}}), "eb-sites")
    site = F.broadcast(site) if site.count() <= MAX_BROADCAST_SITES else site
    out = rows.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    for k in LABELS:
        own = F.col(f"p_{k}")
        above = (F.col(f"host_s_{k}") - own + F.col(f"host_weight_{k}") * F.col(f"mean_{k}")) / (F.col("host_n") - 1 + F.col(f"host_weight_{k}"))
        rate = (F.col(f"sum_{k}") - own + F.col(f"path_weight_{k}") * above) / (F.col("n") - 1 + F.col(f"path_weight_{k}"))
        out = out.withColumn(f"site_{k}", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)))
        out = out.withColumn(f"all_{k}", _squash(F.col(f"logit_{k}") - _logit(F.col(f"mean_{k}")) + _logit(F.col(f"site_{k}"))))
    return out.select(
        "doc_id", "host", "path", *[f"doc_{k}" for k in LABELS], *[f"site_{k}" for k in LABELS], *[F.col(f"all_{k}").alias(f"p_{k}") for k in LABELS], ((F.col("all_quality") >= 0.5) & (F.col("all_toxic") < 0.5)).alias("kept")
    )


def addresses(pages: DataFrame) -> DataFrame:
    """(page_doc, page_host, page_path): where a document was found, from the page whose URL names it; of several pages
    the first by page_id."""
    named = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)/\d+", 1).alias("path"), F.expr(r"try_cast(regexp_extract(url, '/(\\d+)(\\.html|/)?([?#].*)?$', 1) AS bigint)").alias("page_doc"))
    first = named.where("page_doc is not null and host <> ''").groupBy("page_doc").agg(F.min(F.struct("page_id", "host", "path")).alias("x"))
    return first.select("page_doc", F.col("x.host").alias("page_host"), F.col("x.path").alias("page_path"))


def op9_classifier(spark, sf_dir: str) -> DataFrame:
    """Documents under the host and path of their page; those without a page under their source and language."""
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return classify(docs, labels, F.col("source"), F.col("lang"), places=addresses(pages))
