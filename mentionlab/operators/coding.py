"""Human and model coding: batched classifiers, blinded routing, parsing of answers, decision rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.operators.population import without

#: Titles of one call of an external classifier.
BATCH = 80


def classify_batches(df: DataFrame, text: str, classifier: Callable[[list[str]], list[int]], name: str = "relevant", batch: int = BATCH) -> DataFrame:
    """df with a 0/1/null column from a pluggable classifier that returns the indices it accepts of a list of texts. A call
    that fails leaves null, for another try; null texts are not sent."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            out: list[int | None] = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                try:
                    yes = set(classifier([texts[i] for i in some]))
                except Exception:  # the service's failure is data: null
                    continue
                for k, i in enumerate(some):
                    out[i] = int(k in yes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def route_units(articles: DataFrame, key: str, entities: str) -> DataFrame:
    """Per unit: at most one entity named in its blinded texts is coded mechanically, more are escalated to a coder."""
    each = articles.select(key, F.explode_outer(entities).alias("entity"))  # a unit's set is of entities, however many its texts
    g = each.groupBy(key).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return g.select(key, "entities", F.when(F.size("entities") <= 1, "mechanical").otherwise("escalate").alias("route"), F.when(F.size("entities") == 1, F.col("entities")[0]).alias("entity"))


def parse_answer(text: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a code fence; null where it is no JSON. Fields outside the schema are dropped."""
    return F.from_json(F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")), schema)


def cut_words(text: Column, chars: int) -> Column:
    """The first `chars` characters, cut back to the last whole word."""
    head = F.substring(text, 1, chars)
    return F.when(F.length(text) <= chars, text).otherwise(F.regexp_replace(head, r"\s+\S*$", ""))


def projection(rate: Column, count: Column, factor: float, shrink: float = 0.8) -> tuple[Column, Column]:
    """Expected units of a full run and a cautious figure."""
    full = rate * count * factor
    return full, full * shrink


def decision(found: Column, go: int, limited: int, stop: int) -> Column:
    """Four-way rule on a projected number of exposed units."""
    return F.when(found >= go, "go").when(found >= limited, "go, limited").when(found >= stop, "widen").otherwise("stop")


def gold_sample(units: DataFrame, key: str, exposed: Column, size: int = 28, seed: int = 20260825) -> DataFrame:
    """All exposed units, and others in the order of seeded digests up to `size` in all; a null exposure is none."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    hot = F.coalesce(exposed, F.lit(False))
    first = units.where(hot)
    return first.unionByName(units.where(~hot).orderBy(digest, key).limit(max(0, size - first.count())))


def shuffled(units: DataFrame, key: str, seed: int = 20260825) -> DataFrame:
    """Units in an order that says nothing of their kind."""
    return units.orderBy(F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col(key).cast("string"))), key)


def sweep(linkages: Callable[[float], DataFrame], thresholds: tuple[float, ...]) -> DataFrame:
    """linkages(theta) gives (cluster, size): for each threshold its clusters, those of several members, and the largest."""
    out = None
    for theta in thresholds:
        c = linkages(theta).select("cluster", "size").distinct()
        one = c.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") > 1).alias("linked"), F.max("size").alias("largest")).select(F.lit(theta).alias("theta"), "*")
        out = one if out is None else out.union(one)
    return out


def drawn(units: DataFrame, key: str, size: int = 60, seed: int = 7) -> DataFrame:
    """A sample of `size` units for a look by hand, the first in the order of seeded digests."""
    return units.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)


def validated(answers: DataFrame, required: list[str], allowed: dict[str, list] | None = None) -> DataFrame:
    """A model's answers after its schema: without forbidden fields, values outside a field's list as null, and `missing`,
    the required fields that have none."""
    out = without(answers)
    for c, values in (allowed or {}).items():
        out = out.withColumn(c, F.when(F.col(c).isin(values), F.col(c)))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return out.withColumn("missing", missing)
