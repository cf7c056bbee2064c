import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mentionlab.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint) -> component of each, comparing all with all."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(f)) <= 3):
            a, b = root(f), root(fps[j])
            up[max(a, b)] = min(a, b)
    low = {}
    for d, f in pairs:
        r = root(f)
        low[r] = min(low.get(r, d), d)
    return {(d, f): low[root(f)] for d, f in pairs}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op4_simhash(spark, sf_dir).collect()}
    pairs = [(d.doc_id, plain(d.text)) for d in docs]
    want = brute_components(pairs)
    assert len(got) == len(docs)
    for d, f in pairs:
        assert got[d] == (f, want[d, f])


def test_links_of_large_groups(spark):
    """A third of the fingerprints close together, over tiles and task borders."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 6), replace=False)) for _ in range(300)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 600)}
    fps = sorted(near | far)
    for tile in (16, 2048):
        df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
        got = simhash.connected_components(simhash.links(df, tile=tile)).collect()
        low = {r.node: r.component for r in got}
        want = brute_components([(f, f) for f in fps])
        assert {f: low.get(f, f) for f in fps} == {f: want[f, f] for f in fps}


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (4, " \n", "c"), (7, "One two", "d"), (6, "one  TWO", "e"), (8, "x " * 50000, "f"), (8, "x " * 50000, "f"), (None, "lonely words are these", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (4, 3), (7, 6), (6, 6), (8, 8), (8, 8), (None, None)], key=str)
    for loose in (True, False):
        kept = simhash.representatives(docs, loose=loose)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 6, 8]
    apart = [(None, "first text without an id " * 9, "a"), (None, "another one with quite different words " * 9, "b"), (1, "repeated id one " * 9, "c"), (1, "same id but nothing else in common " * 9, "d"), (None, "another one with quite different words " * 9, "e")]
    docs = spark.createDataFrame(apart, "doc_id long, text string, fp string").selectExpr("*", "1 AS _gone", "2 AS _row", "3 AS row")
    for loose in (True, False):
        for ids in (docs, docs.withColumn("doc_id", F.concat(F.lit("id "), F.col("doc_id").cast("string")))):
            kept = simhash.representatives(ids, loose=loose)
            assert kept.columns == docs.columns
            assert sorted(r.text for r in kept.collect()) == sorted({t for _, t, _ in apart})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_spark_hash_agrees(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("one two é")).alias("h")).first()
    assert r.h % (1 << 64) == xxhash.xxh64_intdigest("one two é".encode(), 42)


def test_loose_copies(spark):
    """Copies with every sixtieth word changed are found, texts that share a quarter of their words in order are not."""
    rng = np.random.default_rng(9)
    word = lambda: "w%d" % rng.integers(0, 10**9)
    rows = []
    for k in range(30):
        base = [word() for _ in range(400)]
        near = [word() if i % 60 == 7 else w for i, w in enumerate(base)]
        apart = base[:100] + [word() for _ in range(300)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(apart))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.loose_groups(docs).collect()}
    assert sum(got[3 * k + 1] == 3 * k for k in range(30)) >= 29
    assert all(got[3 * k + 2] == 3 * k + 2 for k in range(30))


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_loose_copies_on_both_sides_of_the_rule(spark):
    """Appended, replaced and scattered words: pairs at 0.8 and a little more are linked however they differ, those below by the exact rule only."""
    rng = np.random.default_rng(4)
    word = lambda: "w%d" % rng.integers(0, 10**9)
    rows, want = [], {}
    for k in range(240):
        n = (150, 400)[k % 2]
        base = [word() for _ in range(n)]
        m = round((n - 4) * (0.2, 0.24, 0.3, 0.42)[k // 6 % 4])
        if k % 3 == 0:
            near = base + [word() for _ in range(m)]
        elif k % 3 == 1:
            near = base[:20] + [word() for _ in range(m // 2)] + base[20 + m // 2 :]
        else:
            near = [word() if i % 5 == 2 and i < m // 2 else w for i, w in enumerate(base)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        close = (plain(rows[-2][1]) ^ plain(rows[-1][1])).bit_count() <= 3  # the exact rule links too
        want[2 * k + 1] = 2 * k + (jaccard(rows[-2][1], rows[-1][1]) < 0.8 and not close)
    assert 60 < sum(k == v for k, v in want.items()) < 180
    got = {r.doc_id: r.component_id for r in simhash.loose_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want


def test_loose_copies_in_crowded_keys(spark):
    """Groups of copies of one text, near enough to it or to each other only, are what comparing all pairs finds."""
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(0, 10**9)
    texts = []
    for share in (8, 14, 24):
        base = [word() for _ in range(200)]
        for _ in range(60):
            at = int(rng.integers(0, 200 - share))
            texts.append(" ".join(base[:at] + [word() for _ in range(share)] + base[at + share :]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    prints = [plain(t) for t in texts]
    linked = [[j for j in range(len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(texts))]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        now = [min(low[j] for j in of) for of in linked]
        if now == low:
            break
        low = now
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for tile, crowd, cell in ((2048, 8, simhash.CELL), (16, 1, 9000), (64, 2, 2000)):
        got = {r.doc_id: r.component_id for r in simhash.loose_groups(docs, tile=tile, crowd=crowd, cell=cell).collect()}
        assert [got[i] for i in range(len(texts))] == low
