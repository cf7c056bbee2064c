"""The study's models over one frame: contrasts, controls, sensitivities, subgroups, mediators.

The study's effects are adjusted and exchangeable: all frames of a family are fitted by the same jobs (frames.effects).
Without covariates and with an independence working correlation the model of a cluster-constant exposure is closed: its
log odds ratio is that of the pooled 2 x 2 table, and its robust variance the sum over clusters of squared residuals;
robust_odds and what rests on it give this plainer form, by one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlab.functions.stats import Z95
from mentionlab.operators import frames, inference, models, permutation
from mentionlab.session import written

#: Least rows of a contrast's and of a subgroup's frame, and least exposed incidents of a subgroup.
CONTRAST_ROWS, SUBGROUP_ROWS, SUBGROUP_EXPOSED = 30, 40, 5
#: Levels of a categorical covariate at most.
MAX_LEVELS = 200


def robust_odds(rows: DataFrame, by: str = "frame", outcome: str = "outcome", exposure: str = "exposed", cluster: str = "incident_id", least_rows: int = 0, least_exposed: int = 0) -> DataFrame:
    """For each frame: n, clusters, exposed_clusters, log_or, se (robust), odds_ratio, low, high, p. Estimates are null where
    the frame is below the gates, an arm is empty, or a cell is. Rows with a null outcome are left out."""
    one = rows.where(F.col(outcome).isNotNull()).groupBy(by, F.col(cluster).alias("c")).agg(F.max(exposure).alias("x"), F.sum(outcome).alias("k"), F.count(F.lit(1)).alias("n"))
    arm = one.groupBy(by, "x").agg(F.sum("k").cast("double").alias("k_all"), F.sum("n").cast("double").alias("n_all"), F.count(F.lit(1)).alias("clusters"))
    p = F.col("k_all") / F.col("n_all")
    both = one.join(arm.select(F.col(by).alias("by_"), F.col("x").alias("x_"), p.alias("p_")), F.col(by).eqNullSafe(F.col("by_")) & (F.col("x") == F.col("x_")))
    spread = both.groupBy(by, "x").agg(F.sum((F.col("k") - F.col("n") * F.col("p_")) ** 2).alias("ss"))
    parts = arm.join(spread.withColumnsRenamed({by: "by_", "x": "x_"}), F.col(by).eqNullSafe(F.col("by_")) & (F.col("x") == F.col("x_")))
    inside = F.when((F.col("k_all") > 0) & (F.col("k_all") < F.col("n_all")), F.col("k_all"))
    parts = parts.select(by, "x", "clusters", F.col("n_all").alias("n"), F.log(inside / (F.col("n_all") - inside)).alias("logit"), (F.col("ss") / (inside * (1 - inside / F.col("n_all"))) ** 2).alias("v"))
    of = lambda c, x: F.max(F.when(F.col("x") == x, F.col(c)))
    out = parts.groupBy(by).agg(
        F.sum("n").cast("long").alias("n"), F.sum("clusters").alias("clusters"), F.coalesce(of("clusters", 1), F.lit(0)).alias("exposed_clusters"),
        (of("logit", 1) - of("logit", 0)).alias("log_or"), F.sqrt(of("v", 1) + of("v", 0)).alias("se"),
    )
    ok = (F.col("n") >= least_rows) & (F.col("exposed_clusters") >= least_exposed) & (F.col("se") > 0)
    out = out.withColumns({"log_or": F.when(ok, F.col("log_or")), "se": F.when(ok, F.col("se"))})
    b, s = F.col("log_or"), F.col("se")
    return out.withColumns({"odds_ratio": F.exp(b), "low": F.exp(b - Z95 * s), "high": F.exp(b + Z95 * s), "p": inference.two_sided(F.abs(b / s))})


def framed(rows: DataFrame, frames: dict[str, Column]) -> DataFrame:
    """rows once for each frame whose condition holds, with its name."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in frames.items()]))
    return rows.withColumn("frame", F.explode(found))


def contrasts(rows: DataFrame, pairs: dict[str, tuple[str, ...]], group: str = "entity_group", **columns) -> DataFrame:
    """The exposed arm against other groups, one at a time; pairs {name: groups of the frame}. Holm-adjusted."""
    fits = robust_odds(framed(rows, {n: F.col(group).isin(*g) for n, g in pairs.items()}), least_rows=CONTRAST_ROWS, **columns)
    return inference.holm(fits, "frame")


def controls(rows: DataFrame, outcome: str, other: Column, exposed: Column) -> DataFrame:
    """Negative controls: another outcome with the study's exposure, and another exposure among the unexposed."""
    a = rows.select("incident_id", F.lit("outcome control").alias("frame"), F.col(outcome).cast("int").alias("outcome"), exposed.cast("int").alias("exposed"))
    b = rows.where(~F.coalesce(exposed, F.lit(False))).select("incident_id", F.lit("exposure control").alias("frame"), F.col("outcome").cast("int").alias("outcome"), F.coalesce(other, F.lit(False)).cast("int").alias("exposed"))
    return robust_odds(a.unionByName(b))


def subgroups(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each level of each column, behind the gates; levels without an estimate stay, without numbers."""
    levels = F.explode(F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in columns]))
    return robust_odds(rows.withColumn("frame", levels), least_rows=SUBGROUP_ROWS, least_exposed=SUBGROUP_EXPOSED)


def design(rows: DataFrame, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """rows with a 0/1 column for each level of each category but its first, and the names of all covariates. Null is a
    level of its own; a column of more than MAX_LEVELS levels is no category and raises ValueError."""
    names, made = list(numeric), {}
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in dict.fromkeys(categorical)}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v.alias("level")) for c, v in values.items()])).alias("x")
    found = rows.select(pairs).select("x.*").distinct().limit(MAX_LEVELS * len(values) + 1).collect() if values else []  # more than these: one has too many
    for c, value in values.items():
        levels = sorted(r.level for r in found if r.c == c)
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        for k, level in enumerate(levels[1:]):
            made[f"{c}_{k}"] = (value == level).cast("double")
            names.append(f"{c}_{k}")
    return rows.withColumns(made) if made else rows, names


def adjusted(rows: DataFrame, outcome: str, exposure: str, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), exchangeable: bool = True) -> dict:
    """Effect of the exposure with covariates: odds_ratio, low, high, p, alpha; None where the model has no estimate."""
    data, names = design(rows.where(F.col(outcome).isNotNull()), numeric, categorical)
    g = models.gee(data.withColumn("y_", F.col(outcome).cast("double")), [exposure, *names], y="y_", exchangeable=exchangeable)
    odds, low, high, p = models.effect(g["beta"][1], g["se"][1])
    return {"odds_ratio": odds, "low": low, "high": high, "p": p, "alpha": g["alpha"]}


def _first_columns(rows: DataFrame, outcome: Column, exposed: Column, frame: str) -> DataFrame:
    return rows.withColumns({"frame": F.lit(frame), "outcome": outcome.cast("int"), "exposed": exposed.cast("int")})


def adjusted_contrasts(rows: DataFrame, pairs: dict[str, tuple[str, ...]], numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), group: str = "entity_group", matched: DataFrame | None = None) -> DataFrame:
    """The family of secondary comparisons: the exposed arm against other groups, adjusted and exchangeable, and the matched
    pairs within incidents (matched: the row of inference.discordance). frame, n, log_or, se, odds_ratio, low, high, p,
    p_holm; a frame below the gate or without an estimate is no test of the family and has no numbers."""
    data, names = design(framed(rows, {n: F.col(group).isin(*g) for n, g in pairs.items()}), numeric, categorical)
    fits = frames.effects(data, "exposed", names, least_rows=CONTRAST_ROWS).select("frame", "n", "log_or", "se", "odds_ratio", "low", "high", "p")
    if matched is not None:
        own = matched.select(F.lit("within incidents").alias("frame"), sum((F.col(c) for c in "bcd"), F.col("a")).cast("long").alias("n"), F.log("odds_ratio").alias("log_or"), F.sqrt(1 / F.when(F.col("b") > 0, F.col("b")) + 1 / F.when(F.col("c") > 0, F.col("c"))).alias("se"), "odds_ratio", "low", "high", F.when(F.col("a") + F.col("b") + F.col("c") + F.col("d") > 0, F.col("p")).alias("p"))
        fits = fits.unionByName(own)
    found = {r.frame: r for r in fits.collect()}  # a row for each comparison
    fits = rows.sparkSession.createDataFrame([tuple(r) for r in found.values()], fits.schema)
    return fits.join(inference.holm(fits, "frame").select("frame", "p_holm"), "frame", "left")


def adjusted_controls(rows: DataFrame, outcome: str, other: Column, numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> DataFrame:
    """Negative controls, adjusted and exchangeable: another outcome with the study's exposure, and another exposure among
    the unexposed."""
    a = _first_columns(rows, F.col(outcome), F.col("exposed"), "outcome control")
    b = _first_columns(rows.where("exposed = 0"), F.col("outcome"), F.coalesce(other, F.lit(False)), "exposure control")
    data, names = design(a.unionByName(b), numeric, categorical)
    return frames.effects(data, "exposed", names)


def adjusted_sensitivities(rows: DataFrame, conditions: dict[str, Column], numeric: tuple[str, ...] = (), categorical: tuple[str, ...] = (), outcomes: dict[str, str] | None = None, wire: DataFrame | None = None) -> DataFrame:
    """The adjusted model on parts of the rows (conditions), with other outcomes ({frame: column}), on `wire` (one article of
    each wire group), with an independence working correlation and without covariates: a frame each, in one fit."""
    both = {"independence": F.lit(True), "unadjusted": F.lit(True)}
    named = framed(rows, conditions | {n: F.lit(True) for n in outcomes or {}} | both)
    chosen = F.col("outcome")
    for n, c in (outcomes or {}).items():
        chosen = F.when(F.col("frame") == n, F.col(c)).otherwise(chosen)
    named = named.withColumn("outcome", chosen)
    if wire is not None:
        named = named.unionByName(wire.withColumn("frame", F.lit("one per wire group")))
    data, names = design(named, numeric, categorical)
    uses = {f: names for f in [*conditions, *(outcomes or {}), *(["one per wire group"] if wire is not None else []), "independence"]} | {"unadjusted": []}
    return frames.effects(data, "exposed", uses, independent={"independence"})


def exchangeable_subgroups(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each level of each column behind the gates, unadjusted and exchangeable; levels without an estimate stay."""
    levels = F.explode(F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in columns]))
    return frames.effects(rows.withColumn("frame", levels), "exposed", [], least_rows=SUBGROUP_ROWS, least_exposed=SUBGROUP_EXPOSED)


def model_suite(spark: SparkSession, rows: DataFrame, exposure: str, numeric: tuple[str, ...], categorical: tuple[str, ...], mediators: tuple[str, ...]) -> DataFrame:
    """The adjusted model, with mediators added, with independence, and without covariates: one row each, of one fit."""
    data, names = design(framed(rows, {n: F.lit(True) for n in ("adjusted", "mediators added", "independence", "unadjusted")}), numeric, categorical)
    uses = {"adjusted": names, "mediators added": [*names, *mediators], "independence": names, "unadjusted": []}
    fits = frames.effects(data, exposure, uses, independent={"independence"})
    return fits.select(F.col("frame").alias("model"), "odds_ratio", "low", "high", "p", "alpha")


def sweep_with_tests(spark: SparkSession, incidents: DataFrame, thresholds: tuple[int, ...], times: int = permutation.TIMES) -> DataFrame:
    """incidents(k, n, outlets, exposed): at each outlet threshold the arms, their difference and the permutation p, and
    whether it is exact. One roll-up serves all thresholds: it is counted by (threshold, k, n, exposed) once."""
    passed = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("outlets")))
    kinds = incidents.groupBy("outlets", "k", "n", "exposed").agg(F.count(F.lit(1)).alias("c"))
    kinds = written(kinds.select("*", passed.alias("min_outlets")).groupBy("min_outlets", "k", "n", "exposed").agg(F.sum("c").alias("c")), "sweep")
    of = lambda c, x: F.coalesce(F.sum(F.when(F.col("exposed") == x, F.col(c) * F.col("c"))), F.lit(0)).alias(f"{c}{x}")
    arms = kinds.groupBy("min_outlets").agg(*[of(c, x) for x in (1, 0) for c in "kn"])
    every = spark.createDataFrame([(t,) for t in thresholds], "min_outlets int")
    tests = permutation.permutation_frames(kinds, "min_outlets", times, count="c").select(F.col("frame").cast("int").alias("min_outlets"), "p", "exact")
    out = every.join(arms, "min_outlets", "left").join(tests, "min_outlets", "left")
    rate = lambda x: F.when(F.col(f"n{x}") > 0, F.col(f"k{x}") / F.col(f"n{x}"))
    return out.select("min_outlets", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "n1", "k0", "n0")], (rate(1) - rate(0)).alias("diff"), "p", "exact")
