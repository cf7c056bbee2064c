"""Reliability of codings: weighted kappa of ordered values, samples for second coders, the check of an automated outcome,
and credits of news agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.functions.text import WORD
from mentionlab.operators import ranks
from mentionlab.session import fresh

#: Shares of units for a second coder and for the check of the outcome, and the most that may differ there.
DUAL_SHARE, CHECK_SHARE, MAX_DISAGREEMENT = 0.20, 0.15, 0.02
#: Names that a news agency's credit has.
AGENCIES = ("AAP", "Australian Associated Press")
#: Order of where an entity is named first, from most to least prominent.
POSITIONS = ("headline", "standfirst", "first_paragraph", "later_body", "absent")


def place_of(value: Column, order: tuple[str, ...] = POSITIONS) -> Column:
    """A value's place in an order, from 0; null if it is none of it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1)


def weighted_kappa(pairs: DataFrame, a: str, b: str, *by: str, quadratic: bool = True) -> DataFrame:
    """n and Cohen's kappa with weights: disagreement counts by the distance of two ordered codes, or its square. Pairs with a
    null are left out; kappa is null where chance disagreement is 0.

    Rows are counted by cell first. Expected squares follow from the marginals' moments, expected distances from their
    running sums over distinct codes, so codes are never paired with each other.
    """
    cell = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    apart = (F.col("x") - F.col("y")) ** 2 if quadratic else F.abs(F.col("x") - F.col("y"))
    sums = [F.sum("c").alias("n"), F.sum(apart * F.col("c")).alias("seen"), *[F.sum(F.col(v) ** p * F.col("c")).alias(f"{v}{p}") for v in "xy" for p in (1, 2)]]
    out = cell.groupBy(*by).agg(*sums) if by else cell.agg(*sums)
    n = F.col("n").cast("double")
    if quadratic:
        out = out.withColumn("chance", F.col("x2") + F.col("y2") - 2 * F.col("x1") * F.col("y1") / n)
    else:
        one = cell.select(*by, F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("c").alias("r"), F.lit(0).cast("long").alias("k")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("r"), F.col("c").alias("k")))).alias("s")).select(*by, "s.*")
        one = one.groupBy(*by, "v").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))  # a row for each distinct code
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("v")
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = one.select(*by, (F.lead("v").over(w) - F.col("v")).alias("gap"), F.sum("r").over(so_far).alias("rs"), F.sum("k").over(so_far).alias("ks"))
        joined = steps.join(out.select(*by, "n"), list(by)) if by else steps.crossJoin(out.select("n"))  # one row
        chance = F.sum(F.col("gap") * (F.col("rs") * (F.col("n") - F.col("ks")) + F.col("ks") * (F.col("n") - F.col("rs"))) / F.col("n")).alias("chance")
        found = joined.groupBy(*by).agg(chance) if by else joined.agg(chance)
        out = out.join(found, list(by), "left") if by else out.crossJoin(found)
    return out.select(*by, "n", F.when(F.col("chance") > 1e-12, 1 - F.col("seen") / F.col("chance")).alias("weighted_kappa"))


def sampled_share(units: DataFrame, key: str, share: float, seed: int = 20260101, by: str | None = None) -> DataFrame:
    """The units of a random sample of exactly ceil(share * n), of each stratum if `by` is given: those with the smallest
    digests of seed and key. Units are ranked by ranges, so a stratum of any size is spread. The key tells units apart."""
    stratum, digest, place, first, n = fresh(units, "stratum", "digest", "place", "first", "size")
    s = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    made = units.withColumns({stratum: s, digest: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))})
    placed = ranks.numbered(made, place, F.col(stratum), F.col(digest), F.col(key))
    sizes = placed.groupBy(F.col(stratum).alias(f"{stratum}_of")).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    kept = placed.join(sizes, F.col(stratum) == F.col(f"{stratum}_of")).where(F.col(place) - F.col(first) < F.ceil(F.col(n) * share))
    return kept.select(*units.columns)


def outcome_check(human: DataFrame, automated: DataFrame, key: str, value: str, most: float = MAX_DISAGREEMENT) -> DataFrame:
    """One row: how many units both have, how many differ (a null differs from a value), the share, and the verdict: `keep` the
    lexicon, `revise` it, or `no data`."""
    both = human.select(key, F.col(value).alias("h")).join(automated.select(key, F.col(value).alias("m")), key)
    t = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("h").eqNullSafe(F.col("m"))).alias("differ"))
    share = F.when(F.col("n") > 0, F.col("differ") / F.col("n"))
    return t.select("n", "differ", share.alias("share"), F.when(F.col("n") == 0, "no data").when(share > most, "revise").otherwise("keep").alias("verdict"))


def agency_credit(text: Column, agencies: tuple[str, ...] = AGENCIES) -> Column:
    """Does a text carry an agency's credit: one of its names as a word, in its first or last line that is not blank? Names
    are matched as they are written; null says no."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    names = "|".join(rf"\Q{a}\E" for a in agencies)
    hit = lambda x: F.coalesce(x.rlike(rf"(?<!{WORD})(?:{names})(?!{WORD})"), F.lit(False))
    return hit(F.get(lines, F.lit(0))) | hit(F.get(lines, F.size(lines) - 1))
