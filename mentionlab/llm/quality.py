"""Operator 8: quality rules with risk-controlled thresholds.

Per-document counts come from array functions on the document's own row, so nothing is shuffled for them. Cutoffs are
not hand-set: they are tried on the labelled documents of a stratum along paths that are fixed before any label is seen.
A path is one rule, or all rules with a common cutoff; its steps go from the loosest cutoff to the tightest. A step is
usable only if the exact binomial (Clopper-Pearson) upper bound of the rate at which it rejects good documents, by any of
its rules together, stays within max_false_rejection.

Multiple testing: a path's steps are tested in order up to the first failure (a fixed sequence needs no further
correction); over paths and strata the error level is divided by their number. So with confidence 1 - alpha no usable
step of any stratum rejects more than that part of its good documents, and any of them may be chosen: the one with the
largest excess of bad over good rejections is, the loosest of equals, the joint path last. Where none gains anything, or
where the labels are too few, the stratum rejects nothing.

Labels needed: with no good document lost a step is usable from log(alpha / tests) / log(1 - max_false_rejection) good
labels, 297 for four strata with the values below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import fresh, identified, table, text_of, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Part of a stratum's good documents that the thresholds may reject, and the error level of that guarantee.
MAX_FALSE_REJECTION, ALPHA = 0.02, 0.05
#: Cutoffs tried for every rule, loosest first; fixed before any label is seen.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.075, 0.05, 0.03)
#: Scores of the rules, larger is worse, each in 0..1.
RULES = ("symbols", "dup_lines", "repeats", "capitals")
#: Paths of cutoffs: each rule alone, and all rules with a common cutoff.
JOINT = "any"
PATHS = (*RULES, JOINT)
#: A table of strata up to this many rows is sent to every executor; beyond, it is joined.
MAX_BROADCAST_STRATA = 10_000
#: Rows that go, sent to the executors up to this many.
MAX_BROADCAST_IDS = 500_000


def with_counts(docs: DataFrame, text: str, out: dict[str, str]) -> DataFrame:
    """docs with the counts named in out: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps.

    n_repeat_words: three-word windows are hashed; only where a hash occurs twice are (hash, position) pairs sorted,
    equal neighbours kept, and the words under them counted once. A text of one or two words has no window.
    """
    t, w, h, s, p = fresh(docs, "text", "words", "hashes", "sorted", "places")
    keep = list(docs.columns)
    df = docs.withColumn(t, text_of(text)).withColumn(w, words_of(F.col(t)))
    n = F.size(w)
    df = df.withColumn(h, F.when(n >= 3, F.transform(F.slice(w, F.lit(3), F.greatest(n, F.lit(1))), lambda x, i: F.xxhash64(F.col(w)[i], F.col(w)[i + 1], x))))
    twice = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn(s, F.when(twice, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda j, x: F.col(s)[j]["h"] == x["h"]
    df = df.withColumn(p, F.array_sort(F.transform(F.filter(s, lambda x, j: ((j > 0) & same(F.greatest(j - 1, F.lit(0)), x)) | ((j < F.size(s) - 1) & same(F.least(j + 1, F.size(s) - 1), x))), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(p, start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    (line,) = fresh(df, "lines")
    df = df.withColumn(line, lines)
    made = {
        "n_words": n.cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(line).cast("long"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_caps": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
    }
    # filters on the counts must not be pushed below this point, where they would repeat the work: a generator stops them
    (all_,) = fresh(df, "counts")
    df = df.select(*keep, F.explode(F.array(F.struct(*[made[k].alias(k) for k in out]))).alias(all_))
    return df.select(*keep, *[F.col(all_)[k].alias(v) for k, v in out.items()])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def scores(c) -> dict[str, Column]:
    """Scores of the rules from the counts; c(name) gives a count's column."""
    of = lambda part, whole: part / F.greatest(whole, F.lit(1))
    return {"symbols": of(c("n_symbols"), c("word_chars")), "dup_lines": of(c("n_dup_lines"), c("n_lines")), "repeats": of(c("n_repeat_words"), c("n_words")), "capitals": of(c("n_caps"), c("word_chars"))}


def tail_at_most(x: Column, n: Column, rate: float, level: Column) -> Column:
    """P(Binomial(n, rate) <= x) <= level, that is: the exact upper bound at that level is at most rate.

    The sum runs in logarithms from term 0; where x is not below n * rate the probability is near a half or more.
    """
    odds = F.lit(rate / (1 - rate))
    zero = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), (n * F.log(F.lit(1 - rate))).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    total = F.aggregate(F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>")), zero, add, lambda a: a["total"])
    return (n > 0) & (x < n * rate) & (F.when(x < n * rate, total).otherwise(0.0) <= F.log(level))


def tested(labelled: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """labelled(stratum, good boolean, one column for each rule) -> one row for each stratum, path and step: stratum, path,
    k, cutoff, n (good labels), lost and caught (good and bad ones that the step rejects), ok (it is usable).

    Labelled rows are first counted by stratum, path and the number of cutoffs that the score exceeds: what follows is a
    few rows for each stratum whatever the number of labels.
    """
    grid = F.array(*[F.lit(c) for c in cutoffs])
    of = {**{r: F.col(r) for r in RULES}, JOINT: F.greatest(*[F.col(r) for r in RULES])}
    long = labelled.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), of[p].alias("score")) for p in PATHS])).alias("x")).select("stratum", "good", "x.path", "x.score")
    over = F.aggregate(grid, F.lit(0), lambda a, c: a + F.when(F.col("score") > c, 1).otherwise(0))
    counted = long.groupBy("stratum", "path", over.alias("over")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    per_path = counted.groupBy("stratum", "path").agg(F.sum("good").alias("n"), F.map_from_entries(F.collect_list(F.struct("over", F.struct("good", "bad")))).alias("at"))
    per_path = written(per_path, "quality-paths")
    tests = max(1, per_path.count())
    step = per_path.select("*", F.posexplode(grid).alias("k", "cutoff"))
    at_least = lambda what: F.aggregate(F.filter(F.map_entries("at"), lambda e: e["key"] >= len(cutoffs) - F.col("k")), F.lit(0).cast("long"), lambda a, e: a + e["value"][what])
    step = step.withColumn("lost", at_least("good")).withColumn("caught", at_least("bad"))
    step = step.withColumn("ok", tail_at_most(F.col("lost"), F.col("n"), max_false_rejection, F.lit(alpha / tests)))
    so_far = Window.partitionBy("stratum", "path").orderBy("k")
    return step.withColumn("ok", F.min("ok").over(so_far)).select("stratum", "path", "k", "cutoff", "n", "lost", "caught", "ok")


def thresholds(labelled: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, alpha: float = ALPHA, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """One row for each stratum of labelled rows with the cutoff of each rule (max_<rule>), null where it rejects nothing.
    Labelled rows with a null label must be left out before."""
    step = tested(labelled, max_false_rejection, alpha, cutoffs).withColumn("gain", F.col("caught") - F.col("lost"))
    order = F.array_position(F.array(*[F.lit(p) for p in PATHS]), F.col("path"))
    choice = F.struct("gain", (-F.col("k")).alias("k"), (-order).alias("order"), "path", "cutoff")
    best = step.groupBy("stratum").agg(F.max(F.when(F.col("ok") & (F.col("gain") > 0), choice)).alias("best"))
    return best.select("stratum", *[F.when(F.col("best.path").isin(r, JOINT), F.col("best.cutoff")).alias(f"max_{r}") for r in RULES])


def _judged(df: DataFrame, limits: DataFrame, c, stratum: Column, kept: str) -> DataFrame:
    """df with kept; limits are joined by stratum, sent to every executor if counted to be few."""
    limits = written(limits, "quality-limits")
    few = limits.count() <= MAX_BROADCAST_STRATA
    (s,) = fresh(df, "stratum")
    names = fresh(df.withColumn(s, F.lit(0)), *[f"max_{r}" for r in RULES], "there")
    limits = limits.select(F.col("stratum").alias(names[-1]), *[F.col(f"max_{r}").alias(n) for r, n in zip(RULES, names)])
    joined = df.withColumn(s, stratum).join(F.broadcast(limits) if few else limits, F.col(s).eqNullSafe(F.col(names[-1])), "left")
    good = ~base_failed(c("n_words"), c("n_repeat_words"))
    for r, score in scores(c).items():
        good = good & ~F.coalesce(score > F.col(names[RULES.index(r)]), F.lit(False))
    return joined.withColumn(kept, good).drop(s, *names)


def _labels(labels: DataFrame) -> DataFrame:
    """A verdict for each labelled id, the worst of repeated ones; null ids and labels say nothing."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") > 0).alias("good"))


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept.

    Null text has no words and fails the base rule. Null stratum is a stratum of its own. Without labels no cutoff is
    usable and the base rule alone decides. Repeated doc_ids are judged row by row.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")
    only = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    counts = written(with_counts(only, "text", {n: n for n in names}).drop("text"), "quality-counts")
    labelled = counts.join(_labels(labels), F.col("doc_id") == F.col("label_id")).select("stratum", "good", *[s.alias(r) for r, s in scores(F.col).items()])
    judged = _judged(counts, thresholds(labelled, **how), F.col, F.col("stratum"), "kept")
    return judged.select("doc_id", *names[:5], base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that the rules keep, columns as they were; odd rows as in rate().

    Counts are taken once and written without the texts, by what tells rows apart; the cutoffs read them, and the rows that
    go are taken out of docs: sent to the executors if counted to be few, else joined.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")
    docs, row = identified(docs, doc_id, "quality-docs")
    only = docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    counts = written(with_counts(only, "text", {n: n for n in names}).drop("text"), "quality-counts")
    labelled = counts.join(_labels(labels), F.col("doc_id") == F.col("label_id")).select("stratum", "good", *[s.alias(r) for r, s in scores(F.col).items()])
    (own,) = fresh(docs, "gone")
    gone = _judged(counts, thresholds(labelled, **how), F.col, F.col("stratum"), "kept").where(~F.col("kept")).select(F.col("row").alias(own))
    gone = written(gone, "quality-gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    return docs.join(gone, F.col(row) == F.col(own), "left_anti").drop(row)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
