"""Coder agreement: kappa, exact agreement by variable, recall by entity, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.session import fresh


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, exact agreement and Cohen's kappa of two codings; kappa is null where chance agreement is 1 or nothing is coded.

    Rows are first counted by cell, so everything after is as small as the contingency table.
    """
    cell = pairs.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    rows = cell.groupBy(*by, F.col("x").alias("v")).agg(F.sum("c").alias("r"))
    cols = cell.groupBy(*by, F.col("y").alias("v")).agg(F.sum("c").alias("k"))
    both = rows.join(cols, [*by, "v"])
    chance = both.groupBy(*by).agg(F.sum(F.col("r") * F.col("k")).alias("rk")) if by else both.agg(F.sum(F.col("r") * F.col("k")).alias("rk"))
    same = F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same")
    total = cell.groupBy(*by).agg(F.sum("c").alias("n"), same) if by else cell.agg(F.sum("c").alias("n"), same)
    out = total.join(chance, list(by), "left") if by else total.withColumn("rk", F.lit(chance.first().rk).cast("long"))  # one number
    pe = F.coalesce("rk", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", (F.col("same") / F.col("n")).alias("exact"), F.when(pe < 1, (F.col("same") / F.col("n") - pe) / (1 - pe)).alias("kappa"))


def normal_value(x: Column) -> Column:
    """Codings compared as strings: booleans as 1 and 0, null and None as empty, trimmed."""
    s = F.trim(x.cast("string"))
    return F.coalesce(F.when(s.isin("true", "True"), "1").when(s.isin("false", "False"), "0").when(s == "None", "").otherwise(s), F.lit(""))


def by_variable(gold: DataFrame, machine: DataFrame, key: str, variables: list[str]) -> DataFrame:
    """Agreement of two wide codings, variable by variable, over units in both where either side is not empty."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), normal_value(F.col(v)).alias(name)) for v in variables])).alias("x")).select(key, "x.*")
    pairs = long(gold, "gold").join(long(machine, "machine"), [key, "variable"]).where("gold <> '' or machine <> ''")
    return kappa(pairs, "gold", "machine", "variable")


#: Least kappa (or exact agreement where kappa is not defined) of a variable, and of the exposure's.
LEAST_KAPPA, LEAST_EXACT, LEAST_EXPOSURE = 0.70, 0.85, 0.90
#: Largest difference of recall between exposed and other units, and fewest units for a statistic.
MAX_DIFFERENTIAL, FEW_UNITS = 0.10, 20


def verdicts(gold: DataFrame, machine: DataFrame, key: str, labels: list[str], numbers: list[str] = (), exposure: str | None = None) -> DataFrame:
    """One row for each variable: n, exact, kappa (labels only), threshold, verdict: `pass`, `FAIL`, or `no data`."""
    rows = by_variable(gold, machine, key, [*labels, *numbers])
    all_ = gold.sparkSession.createDataFrame([(v,) for v in (*labels, *numbers)], "variable string")
    kappa_ = F.when(F.col("variable").isin(*labels), F.col("kappa")) if labels else F.lit(None).cast("double")
    out = all_.join(rows, "variable", "left").withColumn("kappa", kappa_)
    least = F.when(F.col("kappa").isNotNull(), LEAST_KAPPA).otherwise(LEAST_EXACT)
    least = F.when(F.col("variable") == exposure, LEAST_EXPOSURE).otherwise(least) if exposure else least
    some = F.col("n").isNotNull()
    verdict = F.when(~some, "no data").when(F.coalesce("kappa", "exact") >= least, "pass").otherwise("FAIL")
    return out.select("variable", F.coalesce("n", F.lit(0)).alias("n"), "exact", "kappa", F.when(some, least).alias("threshold"), verdict.alias("verdict"))


def recall(gold: DataFrame, machine: DataFrame, key: str, value: str, exposed: Column) -> DataFrame:
    """Per entity of the gold coding: units and those where the machine agrees (a missing machine coding is a miss), the
    recall of the exposed entity less that of all others, and whether that is within the limit: never without gold units of
    both."""
    own, got = fresh(gold, "key", "value")
    m = machine.select(F.col(key).alias(own), F.col(value).alias(got))
    joined = gold.join(m, F.col(key) == F.col(own), "left").where(F.coalesce(F.col(value), F.lit("")) != "")
    joined = joined.select(F.col(value).alias("entity"), F.coalesce(F.col(got) == F.col(value), F.lit(False)).cast("int").alias("hit"), F.coalesce(exposed.cast("int"), F.lit(0)).alias("exposed"))
    per = joined.groupBy("entity", "exposed").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    of = lambda x: F.sum(F.when(F.col("exposed") == x, F.col("hits"))) / F.sum(F.when(F.col("exposed") == x, F.col("n")))
    gap = per.agg((of(1) - of(0)).alias("gap")).first()  # one number
    gap = F.lit(gap.gap if gap else None).cast("double")
    return per.select("entity", "n", "hits", (F.col("hits") / F.col("n")).alias("recall"), gap.alias("differential"), F.coalesce(F.abs(gap) <= MAX_DIFFERENTIAL, F.lit(False)).alias("within"))


def passed(variables: DataFrame, recalls: DataFrame) -> bool:
    """The whole validation: no variable fails, and the differential is within its limit."""
    bad = variables.where("verdict = 'FAIL'").count()
    gap = recalls.agg(F.bool_and("within")).first()[0]
    return not bad and bool(gap)


def disagreements(gold: DataFrame, machine: DataFrame, key: str, value: str) -> DataFrame:
    """Units that both have coded, differently: key, your_answer, machine_answer."""
    g = gold.select(key, normal_value(F.col(value)).alias("your_answer"))
    return g.join(machine.select(key, normal_value(F.col(value)).alias("machine_answer")), key).where("your_answer <> machine_answer")


def review_flags(ambiguous: Column, entity: Column, quote: Column, confidence: Column, evidence: Column, limit: float = 0.75) -> Column:
    """Array of reasons for a human look: ambiguous unit, entity without a quote, unsure fields, fields without evidence.
    confidence is map<string, double>, evidence map<string, string>."""
    unsure = F.transform(F.map_keys(F.map_filter(confidence, lambda _, v: v < limit)), lambda k: F.concat(F.lit("low_confidence:"), k))
    bare = F.transform(F.map_keys(F.map_filter(evidence, lambda _, v: F.coalesce(F.trim(v), F.lit("")) == "")), lambda k: F.concat(F.lit("no_evidence:"), k))
    first = F.array(F.when(F.coalesce(ambiguous, F.lit(False)), "ambiguous"), F.when((F.coalesce(entity, F.lit("")) != "") & (F.coalesce(quote, F.lit("")) == ""), "entity_without_quote"))
    empty = F.array().cast("array<string>")
    return F.concat(F.filter(first, lambda x: x.isNotNull()), F.array_sort(F.coalesce(unsure, empty)), F.array_sort(F.coalesce(bare, empty)))
