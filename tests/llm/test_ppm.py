import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mentionlab.llm import ppm

ORDER = 5


class Plain:
    """PPM as it is defined, on lists of successors, apart from the product's code: method C, symbols excluded."""

    def __init__(self):
        self.after = {}

    def learn(self, text):
        data = [-1] * ORDER + list(text) + [-1]
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                self.after.setdefault(tuple(data[i - k : i]), []).append(data[i])

    def freeze(self):
        self.after = {c: Counter(s) for c, s in self.after.items()}

    def log10(self, context, symbol):
        out, banned = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = self.after.get(tuple(context[ORDER - k :]), {})
            open_ = {s: n for s, n in seen.items() if s not in banned}
            if not open_:
                continue
            if symbol in open_:
                return out + math.log10(open_[symbol] / (sum(open_.values()) + len(open_)))
            out += math.log10(len(open_) / (sum(open_.values()) + len(open_)))
            banned |= set(open_)
        return out - math.log10(256 - len(banned))

    def score(self, text):
        data = [-1] * ORDER + list(text) + [-1]
        return sum(self.log10(data[i - ORDER : i], data[i]) for i in range(ORDER, len(data)))


def words(t):
    return (t or "").encode().lower().split()


def brute(rows, held):
    """rows (doc_id, text): base columns and PPM scores, plainly."""
    model, c, taught = Plain(), Counter(), 0
    for d, t in rows:
        if not held(d):
            model.learn((t or "").encode().lower())
            c.update(words(t))
            taught += 1
    model.freeze()
    n, v = c.total() + taught, len(c) + (taught > 0)
    prob = lambda x: math.log10((x + 1) / (n + v + 1))
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(prob(c[x]) for x in w) + prob(taught)
        out.append((d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + (taught > 0), n, base, model.score((t or "").encode().lower())))
    return out


def check(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_query_against_plain_ppm(spark, sf_dir):
    """The query, and again with nearly nothing sent to executors: the same scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want = brute(rows, held)
    check(ppm.op2_ppm(spark, sf_dir).collect(), want)
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    check(ppm.score(docs, out, sent=50, heavy=20).collect(), want)


def test_odd_rows_and_few_heavy_words(spark):
    rows = [(1, None), (2, ""), (3, "Abc abd\tabc é"), (3, "Abc abd\tabc é"), (4, "xyz " * 20000), (5, "unseen \x00 Ω words"), (6, "abcabcabc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS t")
    held = F.col("doc_id").isin(5, 6)
    for sent in (ppm.SENT, 3):
        check(ppm.score(docs, held, heavy=2, sent=sent).collect(), brute(rows, lambda d: d in (5, 6)))
    check(ppm.score(docs, F.lit(True)).collect(), brute(rows, lambda d: True))
    assert ppm.score(docs.limit(0), held).count() == 0
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(docs.where("doc_id in (2, 6)")).collect()}
    assert got[2] == pytest.approx(-math.log10(256))
    assert got[6] == pytest.approx(ppm.Trie().score(b"abcabcabc", adaptive=True))


def test_trie_is_plain_ppm():
    a, b = ppm.Trie(), Plain()
    for t in (b"abracadabra", b"abra", b"", b"candelabra"):
        a.learn(t)
        b.learn(t)
    b.freeze()
    for t in (b"abrakadabra", b"", b"zzz", b"cadab"):
        assert a.score(t) == pytest.approx(b.score(t))


def test_probabilities_sum_to_one(spark, sf_dir):
    """After any context the probabilities of all bytes sum to one, seen or not."""
    model = ppm.Model(ppm.count(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    contexts = [b" the ", b"\xff" * 5, b"qqqqq", b"\xc3\xa9 ab"]
    grams = [(int.from_bytes(c + bytes([s]), "big"),) for c in contexts for s in range(256)]
    strings = spark.createDataFrame(grams, "gram long")
    logs = strings.join(model.own, "gram").select("gram", "log").union(model.unseen(strings.join(model.own, "gram", "left_anti")))
    got = logs.groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum(F.pow(F.lit(10.0), "log")).alias("p"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(r.n == 256 and r.p == pytest.approx(1, abs=1e-9) for r in got)


def test_model_grows_with_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [ppm.Model(ppm.count(d)).own.count() for d in (docs.where("doc_id % 4 = 0"), docs)]
    text = [t or "" for (t,) in docs.select("text").collect()]
    assert sizes[0] < sizes[1]
    assert sizes[1] == len({x[i : i + 6] for t in text for x in [b"\xff" * 5 + t.encode().lower() + b"\xff"] for i in range(len(x) - 5)})
