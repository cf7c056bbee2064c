"""Operator 10: mixing sources to target weights.

Each document gets a hash-random key. Within each source documents are range-sorted by that key, prefix sums of
their word counts are taken range by range, and the order is cut at the source's budget. A budget above the
source's size repeats the whole source as often as it fits and cuts only the last epoch.

Ranges are equal slices of the key space. Keys are uniform, so a slice holds about total / slices rows whatever the
source's share is, and a source of any size is spread over all tasks: there are at least four slices for each task. What
is summed over slices is one row for each source and slice; sources themselves are ranked in one task, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import fresh, identified, n_words_of, table, text_of, written

#: Weights of the sources in order, repeated.
WEIGHTS = (1, 2, 3)
#: A source is read this many times at most.
MAX_EPOCHS = 3
#: Offsets of ranges, one for each source and range, that are sent to executors up to this many rows.
MAX_BROADCAST_RANGES = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with weight and target.

    Sources in code-point order, null last, take the weights in turn and share the total. A target stops at
    max_epochs times its source's size; what it leaves is shared again by weight until none is above. That fixed point
    has one level L for all sources that are not stopped: they get weight * L, and the stopped ones are those with the
    smallest max_epochs * size / weight, so one sorted pass finds it.
    """
    everyone = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(everyone) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")).withColumn(
        "cap", F.lit(max_epochs) * F.col("source_size")
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = weighed.withColumn("level", level).withColumn("stops", F.col("cap") < F.col("level") * F.col("weight"))
    last = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)  # beyond the first that is not stopped, levels only fall
    return found.select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.coalesce(last, F.lit(0.0))).alias("target"))


def _shares(docs: DataFrame, row: str, text: str, source: str, doc_id: str, weights: tuple[int, ...], max_epochs: int, rows_per_range: int, seed: int, size: Column | None) -> DataFrame:
    """For each row of docs, by its number `row`: row, doc_id, source, size, source_size, target, copies."""
    spark = docs.sparkSession
    out = docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (size if size is not None else n_words_of(text_of(text))).alias("size"), F.md5(text_of(text)).alias("digest"))
    key = F.md5(F.concat(F.lit(f"{seed}:" if seed else ""), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    out = written(out.withColumn("key", key).drop("digest"), "mix")
    per_source = out.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = per_source.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_range) * 4)
    goal = targets(per_source.drop("n"), weights, max_epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    keyed = out.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int"))
    # a range partitioning by source and range already holds each pair in one task: the window needs no exchange of its own
    laid = keyed.repartitionByRange("source", "range")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = laid.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    offsets = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "o.range", "o.offset", "g.source_size", "g.target", "g.full", "g.rest")
    offsets = written(offsets, "mix-ranges")
    offsets = F.broadcast(offsets) if offsets.count() <= MAX_BROADCAST_RANGES else offsets
    done = inner.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.range") == F.col("o.range")))
    cut = (F.col("size") > 0) & (F.col("offset") + F.col("inner") + F.col("size") / 2 <= F.col("rest"))
    return done.select("d.row", "d.doc_id", "d.source", "size", "source_size", "target", (F.col("full") + F.when(cut, 1).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = 200_000, seed: int = 0, size: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Documents are whole: the one that the budget cuts is taken if at least half of it lies before the cut. Null text
    has size 0; null source is a source of its own, last. Keys come from id and text, so rows that repeat an id or have
    none spread over the ranges by their texts; rows that repeat both are the same to the mix: so many of them are taken
    as the budget holds, and reruns agree on how many. Empty docs give an empty result. Other columns of docs are not
    looked at.
    """
    (row,) = fresh(docs, "row")
    shares = _shares(docs.withColumn(row, F.monotonically_increasing_id()), row, text, source, doc_id, weights, max_epochs, rows_per_range, seed, size)
    return shares.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = 200_000, seed: int = 0, size: Column | None = None) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it; columns as they were.

    Rows are told apart whatever their ids are: each source's words are the sum of what mix()
    takes, also where ids repeat or are null. Rows without a word come as often as their whole source fits.
    """
    docs, row = identified(docs, doc_id, "mix-docs")
    own, n = fresh(docs, "mix_row", "mix_copies")
    taken = _shares(docs, row, text, source, doc_id, weights, max_epochs, rows_per_range, seed, size)
    taken = taken.where("copies > 0").select(F.col("row").alias(own), F.col("copies").cast("int").alias(n))
    joined = docs.join(taken, F.col(row) == F.col(own)).drop(row, own)
    names = [c for c in joined.columns if c != n]
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).select(*names)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN cap < level * weight THEN cap::DOUBLE
        ELSE weight * coalesce(max(CASE WHEN NOT cap < level * weight THEN level END) OVER (), 0) END AS target FROM l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n FROM g),
p AS (SELECT d.*, h.source_size, h.target, h.n, h.target - h.n * h.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
  ((n + CASE WHEN size > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
