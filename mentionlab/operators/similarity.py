"""TF-IDF similarity joins within date bands or groups, without comparing all pairs.

Vectors are rows (doc, token, w). A pair can reach cosine >= theta only if it shares a token of both documents' prefixes:
with tokens in one global order, rarest first, a document's prefix ends where the rest of its vector is shorter than
theta. Candidates come from an equi-join on (prefix token, band), frequent tokens hardly ever being in a prefix; their
cosines are then summed over all shared tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.operators.components import connected_components
from mentionlab.session import written

THETA, RARE_SHARED, RARE_FRACTION, DAYS = 0.35, 2, 0.002, 3


def token_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, c): term frequencies."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens).alias("token")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("c"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(token, df) of docs that have a row for each document: one shuffle, of a row for each token and task."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(doc, token, df, w): tf = c / length, idf = ln((n + 1) / (df + 1)), L2-normalised; a norm of 0 counts as 1."""
    whole = Window.partitionBy("doc")
    raw = counts.join(document_frequency(counts), "token").withColumn("x", F.col("c") / F.sum("c").over(whole) * F.log((n_docs + 1) / (F.col("df") + 1)))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(whole))
    return raw.select("doc", "token", "df", (F.col("x") / F.when(norm > 0, norm).otherwise(1.0)).alias("w"))


def copies(counts: DataFrame, band: DataFrame) -> DataFrame:
    """(doc, rep): documents with the same token counts in the same band, and the least of them. Copies link to each other
    anyway; pairs are looked up between representatives only, so a large group of copies costs rows, not pairs."""
    sign = counts.groupBy("doc").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("token", "c")))), 256).alias("sign"))
    keyed = sign.join(band, "doc")
    least = keyed.groupBy("sign", "band").agg(F.min("doc").alias("rep"))
    return keyed.join(least, ["sign", "band"]).select("doc", "rep")


def rare_limit(n_docs: int) -> int:
    return max(2, int(n_docs * RARE_FRACTION))


def _candidates(keys: DataFrame, band: DataFrame, days: int | None, theta: float | None = None) -> DataFrame:
    """Pairs a < b that share a (token, band); with days, bands are days and a document is looked up in those around. With
    theta, keys have a tail, and pairs whose tails' lengths at the token cannot reach theta are left out where they meet:
    at the first token that two vectors share, their product is that of their tails. The join is fed by exchanges alone, so
    Spark splits a hot (token, band)."""
    k = keys.join(band, "doc")
    if days is None:
        x, y = k, k
    else:
        x = k.withColumn("band", F.explode(F.sequence(F.col("band") - days, F.col("band") + days)))
        y = k
    a, b = x.alias("a"), y.alias("b")
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.doc") < F.col("b.doc"))
    if theta is not None:
        on = on & (F.col("a.tail") * F.col("b.tail") >= max(0.0, theta - 1e-9) ** 2)
    return a.join(b, on).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"))


def similar_pairs(weights: DataFrame, band: DataFrame, theta: float = THETA, days: int | None = DAYS) -> DataFrame:
    """(a, b, cosine >= theta, to nine digits) of documents in bands at most `days` apart, or in equal bands (None).

    band(doc, band): integer days or group keys; documents without a band are in no pair.
    """
    order = Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = weights.withColumn("tail", F.sum(F.col("w") * F.col("w")).over(order)).where(F.col("tail") >= (theta - 1e-9) ** 2).select("doc", "token", "tail")
    pairs = _candidates(prefix, band, days, theta).distinct()
    w = weights.select("doc", "token", "w")
    left = pairs.join(w.withColumnsRenamed({"doc": "a", "w": "wa"}), "a")
    both = left.join(w.withColumnsRenamed({"doc": "b", "w": "wb"}), ["b", "token"])
    return both.groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 9).alias("cosine")).where(F.col("cosine") >= theta)


def rare_pairs(counts: DataFrame, band: DataFrame, n_docs: int, shared: int = RARE_SHARED, days: int | None = DAYS) -> DataFrame:
    """(a, b, rare): pairs in reach that share at least `shared` rare tokens; a rare token has few documents by definition."""
    rare = document_frequency(counts).where(F.col("df") <= rare_limit(n_docs)).select("token")
    keys = counts.join(rare, "token").select("doc", "token")
    return _candidates(keys, band, days).groupBy("a", "b").agg(F.count(F.lit(1)).alias("rare")).where(F.col("rare") >= shared)


def rare_links(counts: DataFrame, band: DataFrame, n_docs: int, days: int | None = DAYS) -> DataFrame:
    """(a, b): enough links of rare_pairs (two shared tokens) to connect all that these connect.

    Keys are pairs of rare tokens of one document. Documents of a key in order of their days: who is in reach of one is in
    reach of its neighbour or reached through it, so neighbours alone are linked, and rows do not grow with pairs.
    """
    rare = document_frequency(counts).where(F.col("df") <= rare_limit(n_docs)).select("token")
    own = counts.join(rare, "token").select("doc", "token").join(band, "doc")
    keys = own.alias("x").join(own.alias("y"), (F.col("x.doc") == F.col("y.doc")) & (F.col("x.token") < F.col("y.token"))).select("x.doc", "x.band", F.col("x.token").alias("t1"), F.col("y.token").alias("t2"))
    group = ["t1", "t2"] if days is not None else ["t1", "t2", "band"]
    order = Window.partitionBy(*group).orderBy("band", "doc")
    near = keys.select("doc", F.lag("doc").over(order).alias("other"), (F.col("band") - F.lag("band").over(order)).alias("gap") if days is not None else F.lit(0).alias("gap"))
    return near.where(F.col("other").isNotNull() & (F.col("gap") <= (days or 0))).select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers of one length; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def clusters(docs: DataFrame, doc: str, tokens: Column, band: Column, theta: float = THETA, days: int | None = DAYS, rare: bool = True) -> DataFrame:
    """(doc, cluster, size): components of the linkage "cosine >= theta or enough shared rare tokens, in reach". Every row's
    doc is in the result; documents without a band or links are clusters of their own."""
    counts = written(token_counts(docs, doc, tokens), "similarity-counts")
    n = docs.count()
    bands = docs.select(F.col(doc).alias("doc"), band.alias("band")).where("band is not null")
    weights = written(tfidf(counts, n), "similarity-weights")
    same = written(copies(counts, bands), "similarity-copies")
    reps = bands.join(same.where("doc = rep").select("doc"), "doc", "left_semi")
    links = similar_pairs(weights, reps, theta, days).select("a", "b")
    if rare:
        links = links.union(rare_links(counts, reps, n, days=days))
    weighty = weights.where("w <> 0").select("doc").distinct()  # a vector of zeros is not even like its copy
    links = links.union(same.where("doc <> rep").join(weighty, "doc", "left_semi").select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    found = connected_components(links)
    all_ = docs.select(F.col(doc).alias("doc")).join(found, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("cluster"))
    sizes = all_.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return all_.join(sizes, "cluster").select("doc", "cluster", "size")
