"""Operator 1: secret scans: three base patterns, and character Markov models for what has no pattern.

Base kinds are regular expressions. Positions come from the same expression twice: the matches, and the gaps that
splitting leaves; running sums of their lengths in code points are starts and ends. Sums run in blocks of blocks, and
overlaps are found by halving sorted spans, so a text takes time in proportion to its length and matches.

Random strings and ordinary identifiers each have a first-order Markov model over ASCII characters, trained from
labelled samples. A run of key characters that overlaps no base span is a secret of kind `markov` if the log-likelihood
ratio of its transitions reaches MIN_RATIO. Everything is DataFrame functions; the driver sees only the table of
transition counts, which has at most 96 x 96 cells for each label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlab.llm.common import fresh, table, text_of

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: the least length in the pattern keeps the same runs as dropping shorter ones afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
#: Elements of a block of running sums.
BLOCK = 32
#: Runs that the models judge; a run without a letter is a number.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Natural logarithm of the ratio from which a run counts as random: odds of a million to one.
MIN_RATIO = 14.0
#: Labelled training samples: random strings, and documents whose words are taken as ordinary (expected number).
RANDOM_SAMPLES, ORDINARY_DOCUMENTS = 20_000, 2_000


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often the result mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it, in blocks of BLOCK elements and blocks of these."""
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    sums = lambda xs: F.transform(upto(F.size(xs)), lambda b: total(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
    head = lambda xs, i: total(F.slice(xs, i - i % BLOCK + 1, i % BLOCK))
    down = lambda xs, above: F.transform(xs, lambda _, i: F.get(above, F.floor(i / BLOCK).cast("int")) + head(xs, i))
    plain = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

    def of(xs: Column) -> Column:
        return _let(sums(xs), lambda one: _let(sums(one), lambda two: _let(sums(two), lambda three: _let(down(two, plain(three)), lambda t: _let(down(one, t), lambda o: down(xs, o))))))

    return _let(sizes, of)


def spans(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, kind number, end, value) of the leftmost matches that don't overlap, in order; value is a group's
    text."""
    at = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,k:int,end:int,value:string>>")
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0)).alias("value")
    )

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))

        def spanned(starts: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                begin = F.get(starts, i) + F.length(x["gap"])
                return F.struct(begin.alias("start"), F.lit(at).alias("k"), (begin + F.length(x["match"])).alias("end"), x["value"].alias("value"))

            return F.filter(F.transform(found, one), lambda s: F.length(s["value"]) >= least)

        return _let(before(sizes), spanned)

    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(empty)


def meets(c: Column, found: Column) -> Column:
    """Does a span overlap any of an array of spans that are in order and apart? The last that starts before its end is
    found by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(found).alias("high"))

    def half(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        left = F.get(found, mid)["start"] < c["end"]
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_ & left, mid + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~left, mid).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1)).cast("int"))
    n = F.aggregate(steps, start, half, lambda a: a["low"])
    return F.coalesce((n > 0) & (F.get(found, n - 1)["end"] > c["start"]), F.lit(False))


def shown(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_random: int = RANDOM_SAMPLES, n_documents: int = ORDINARY_DOCUMENTS) -> DataFrame:
    """Labelled samples (value, random): digests written in four alphabets, and the words of about n_documents documents,
    picked by the digest of their id, alone and joined as identifiers are."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    of = F.pmod("id", F.lit(4))
    made = F.when(of == 0, F.substring(digest, 1, 32)).when(of == 1, F.regexp_replace(base64, "=", "")).when(of == 2, F.upper(F.regexp_replace(base64, "[+/=]", ""))).otherwise(F.translate(F.substring(base64, 1, 24), "+/", "-_"))
    random = spark.range(n_random).select(made.alias("value"), F.lit(True).alias("random"))
    rows = docs.count()
    cut = format(min(0xFFFFFFFF, int(n_documents / max(rows, 1) * 0xFFFFFFFF)), "08x")
    picked = docs.where(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 8) <= cut)
    words = picked.select(F.regexp_extract_all(text_of(text), F.lit("[A-Za-z]{2,24}"), F.lit(0)).alias("w"))
    n = F.size("w")
    pair = lambda sep, case: F.transform(F.sequence(F.lit(2), n, F.lit(2)), lambda i: F.concat(case(F.col("w")[i - 2]), F.lit(sep), case(F.col("w")[i - 1])))
    joined = F.when(n >= 2, F.concat(pair("_", F.lower), pair("-", F.lower), pair("/", F.lower), pair("", F.initcap), pair("_", F.upper))).otherwise(F.array().cast("array<string>"))
    ordinary = words.select(F.explode(F.concat("w", joined)).alias("value")).withColumn("random", F.lit(False))
    return random.union(ordinary)


def _chars(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.greatest(F.lit(0), F.least(F.lit(95), F.ascii(c) - 32)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each transition (96 * from + to), from labelled(value, random).

    Cells have one count added. With one label missing all ratios are near zero and nothing is found.
    """
    c = labelled.where("length(value) > 1").select("random", _chars(F.col("value")).alias("c"))
    steps = c.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.col("c")[i - 1] * 96 + F.col("c")[i])).alias("step"))
    counted = steps.groupBy("random", "step").count().collect()  # at most 2 x 96 x 96 rows
    count = {True: [1.0] * 9216, False: [1.0] * 9216}
    for r in counted:
        if r["step"] is not None:
            count[r["random"]][r["step"]] += r["count"]
    logs = {}
    for k, v in count.items():
        rows = [sum(v[i * 96 : i * 96 + 96]) for i in range(96)]
        logs[k] = [math.log(x / rows[i // 96]) for i, x in enumerate(v)]
    return [round(a - b, 4) for a, b in zip(logs[True], logs[False])]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ASCII characters: the sum over its transitions."""
    cells = F.split(F.lit(",".join(f"{x:g}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] >= 0, F.get(cells, a["last"] * 96 + c)).otherwise(0.0)).alias("sum"))
    return F.aggregate(_chars(value), start, step, lambda a: a["sum"])


def scan(docs: DataFrame, model: list[float], text: str = "text", names: list[str] | None = None) -> DataFrame:
    """The rows of docs with n_assign, n_access, n_hex, n_markov, base_sha256, spans (or six other names).

    Null text is empty: no spans, empty `spans`, the digest of an empty string. Repeated rows are scanned each for
    itself. Columns of docs stay; a clash with the result's names must be avoided by giving other names.
    """
    names = names or ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    t, base, more, found = fresh(docs, "text", "base", "more", "found")
    df = docs.withColumn(t, text_of(text))
    parts = fresh(df, "assign", "access", "hex")
    for part, (pattern, kind, group, least) in zip(parts, ((ASSIGN, "assign", 2, ASSIGN_MIN), (ACCESS, "access", None, 0), (HEX, "hex", None, 0))):
        df = df.withColumn(part, spans(F.col(t), pattern, kind, group, least))
    df = df.withColumn(base, F.concat(*parts)).withColumn(more, spans(F.col(t), CANDIDATE, "markov"))
    apart = lambda c: ~meets(c, F.col(parts[0])) & ~meets(c, F.col(parts[1])) & ~meets(c, F.col(parts[2]))
    df = df.withColumn(more, F.filter(more, lambda c: c["value"].rlike("[A-Za-z]") & (ratio(c["value"], model) >= MIN_RATIO) & apart(c)))
    made = [*[F.size(p).cast("long") for p in parts], F.size(more).cast("long"), F.sha2(shown(F.col(base)), 256), shown(F.concat(base, more))]
    return df.select(*docs.columns, *[m.alias(n) for m, n in zip(made, names)])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(samples(docs))).drop("text")
