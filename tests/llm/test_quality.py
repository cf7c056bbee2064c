import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionlab.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, e = got[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    long = "aa bb cc " * 30000
    rows = [(1, None, None, "x", 1), (2, "", "en", None, 2), (2, "", "en", None, 2), (3, long, "en", "x", 3), (4, "\n\n a\n a\n\té|é\n a", None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _words string, n_words int")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = sorted(map(tuple, quality.rate(docs, labels).collect()))
    assert [g[0] for g in got] == [1, 2, 2, 3, 4]
    for g, r in zip(got, sorted(rows, key=lambda r: r[0])):
        assert g[1:6] == brute(r[1])
    assert quality.kept_documents(docs, labels).columns == docs.columns
    assert quality.rate(docs.limit(0), labels.limit(0)).count() == 0


def cdf(x, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))


@pytest.mark.parametrize("n,x", [(10, 0), (200, 0), (200, 3), (1500, 0), (1500, 2), (5000, 20), (5000, 4)])
def test_exact_bound(spark, n, x):
    got = spark.range(1).select(quality.tail_at_most(F.lit(x).cast("long"), F.lit(n).cast("long"), 0.005, F.lit(0.01))).first()[0]
    assert got == (x < n * 0.005 and cdf(x, n, 0.005) <= 0.01)


def test_thresholds_hold(spark):
    """Junk is caught where labels suffice; where good rows carry the score too, nothing is rejected."""
    rows = [("a", True, 0.01)] * 3000 + [("a", False, 0.6)] * 50 + [("b", True, 0.01)] * 20 + [("b", False, 0.6)] * 20 + [("c", True, 0.6)] * 3000 + [("c", False, 0.6)] * 50
    df = spark.createDataFrame(rows, "stratum string, good boolean, symbols double").selectExpr("*", "0D dup_lines", "0D repeats", "0D capitals")
    got = {r.stratum: r.max_symbols for r in quality.thresholds(df).collect()}
    assert got == {"a": 0.5, "b": None, "c": None}


def plain_cutoffs(labelled, rate=quality.MAX_FALSE_REJECTION, alpha=quality.ALPHA):
    """labelled (stratum, good, {rule: score}) -> cutoffs of each stratum, with exact binomials."""
    strata = {s for s, _, _ in labelled}
    tests, out = len(strata) * 5, {}
    for s in strata:
        own = [(g, x) for t, g, x in labelled if t == s]
        best = (0, 0, 0, None, None)
        for p, path in enumerate([*quality.RULES, "any"]):
            for k, c in enumerate(quality.CUTOFFS):
                hit = [g for g, x in own if (max(x.values()) if path == "any" else x[path]) > c]
                n, lost = sum(g for g, _ in own), sum(hit)
                if not n or lost >= n * rate or cdf(lost, n, rate) > alpha / tests:
                    break
                if (gain := len(hit) - 2 * lost) > 0:
                    best = max(best, (gain, -k, -p, path, c), key=lambda b: b[:3])
        out[s] = {r: best[4] if best[3] in (r, "any") else None for r in quality.RULES}
    return out


def plain_scores(text):
    n, chars, symbols, dup, rep = brute(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    caps = sum("A" <= c <= "Z" for c in text or "")
    return {"symbols": symbols / max(1, chars), "dup_lines": dup / max(1, len(lines)), "repeats": rep / max(1, n), "capitals": caps / max(1, chars)}


def check_whole(spark, folder, decided):
    """Every cutoff and verdict of the query against exact binomials and plain counts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            labels[r.doc_id] = min(labels.get(r.doc_id, 1), int(r.quality > 0))
    scored = {d.doc_id: plain_scores(d.text) for d in docs}
    want = plain_cutoffs([(d.lang, bool(labels[d.doc_id]), scored[d.doc_id]) for d in docs if d.doc_id in labels])
    assert sum(any(v is not None for v in c.values()) for c in want.values()) >= decided
    got = {r.doc_id: r for r in quality.op8_quality(spark, folder).collect()}
    for d in docs:
        over = any(c is not None and scored[d.doc_id][r] > c for r, c in want.get(d.lang, {}).items())
        assert got[d.doc_id].kept == (not got[d.doc_id].base_failed and not over), (d.doc_id, want.get(d.lang))
    kept = quality.kept_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in got.items() if r.kept}


def test_verdicts_whole_table(spark, sf_dir):
    check_whole(spark, sf_dir, 0)


def test_verdicts_where_labels_suffice(spark):
    """Each of the four languages has labels enough for a decision here."""
    check_whole(spark, "/root/testdata/sf0.1", 4)


def test_cutoffs_against_exact_binomials(spark):
    import random

    rng = random.Random(3)
    rows = []
    for s, n in (("a", 350), ("b", 700), ("c", 2000), (None, 296), ("d", 5)):
        for _ in range(n):
            rows.append((s, True, *(rng.random() ** 6 * (0.5 if rng.random() < 0.01 else 0.12) for _ in range(4))))
        for _ in range(n // 5):
            rows.append((s, False, *(rng.random() ** 3 for _ in range(4))))
    df = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{r} double" for r in quality.RULES))
    got = {r.stratum: {x: r[f"max_{x}"] for x in quality.RULES} for r in quality.thresholds(df).collect()}
    assert got == plain_cutoffs([(r[0], r[1], dict(zip(quality.RULES, r[2:]))) for r in rows])
    assert any(v is not None for v in got["a"].values()) and not any(v is not None for v in got["d"].values())
