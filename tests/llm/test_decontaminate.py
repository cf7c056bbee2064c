import hashlib
import random
import re

from mentionlab.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items):
    w, hit, of = words(doc), set(), set()
    for k, text in items:
        iw = words(text)
        m = min(13, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else ()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                of.add(str(k))
    return len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def small_case():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "é1", "dd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 13, 14, 20, 30]))) for i in range(12)] + [(99, None), (98, ""), (3, "A-b;C")]
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "")) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 40000 + (items[8][1] or ""))]
    return docs, items


def test_against_brute_force_in_one_and_many_chunks(spark):
    docs, items = small_case()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {k: brute(t, items) for k, t in docs}
    for chunk in (10**6, 25):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.scan(d, i, chunk_words=chunk).collect()}
        assert got == want
    clean = dc.clean_documents(d.selectExpr("*", "1 AS n_hit", "2 AS _n_hit"), i)
    assert clean.columns == ["doc_id", "text", "n_hit", "_n_hit"]
    assert {r.doc_id for r in clean.collect()} == {k for k, v in want.items() if not v[4]}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert dc.scan(d, i).first().n_words == 2
    assert dc.scan(d.limit(0), i).count() == 0


def test_shifts_skip_words():
    """In a clean text the scan looks at one place in twelve."""
    t = dc.WuManber(13, {tuple(f"p{i}" for i in range(13)): [0]})
    seen = []

    class Text(list):
        def __getitem__(self, k):
            seen.append(k)
            return super().__getitem__(k)

    assert list(t.find(Text(["x"] * 1200))) == []
    assert len(seen) <= 2 * 1200 / 12
