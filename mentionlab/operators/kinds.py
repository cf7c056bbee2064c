"""Clusters that are alike, counted once: the sums of a model over its clusters need one cluster of each kind.

Two clusters are of a kind if their rows, counted by covariates, are the same set. A kind is known by two 64-bit hashes over
that set, its size and its sums, so a cluster of any size is spread and no rows are gathered; with covariates of a few levels
the number of kinds stops growing long before that of clusters does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a kind is known by.
KIND = ("kind_a", "kind_b", "kind_d", "kind_n", "kind_k")


def of_clusters(data: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """by, c and the kind of each cluster of data(by, c, xs, n, k), whose rows are distinct in (by, c, xs)."""
    told = [y for x in xs for y in (F.coalesce(F.col(x), F.lit(0.0)), F.col(x).isNull())]
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *told, F.coalesce("n", F.lit(0.0)), F.coalesce("k", F.lit(0.0))))
    made = (hashed(0x5851F42D), hashed(0x14057B7E), F.count(F.lit(1)), F.sum("n"), F.sum("k"))
    return data.groupBy(*by, "c").agg(*[v.alias(name) for name, v in zip(KIND, made, strict=True)])


def one_of_each(data: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """The rows of one cluster of each kind, with its kind and w, the number of clusters of it. Rows without a cluster are
    one of their own."""
    some = of_clusters(data.where(F.col("c").isNotNull()), by, xs).groupBy(*by, *KIND).agg(F.min("c").alias("c"), F.count(F.lit(1)).cast("double").alias("w"))
    alone = data.where(F.col("c").isNull())
    alone = alone.select("*", *[F.lit(None).cast(some.schema[n].dataType).alias(n) for n in KIND], F.lit(1.0).alias("w"))
    return data.join(some, [*by, "c"]).select(alone.columns).unionByName(alone)
