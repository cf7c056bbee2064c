import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mentionlab.llm import substrings
from mentionlab.llm.common import table

SCHEMA = "doc_id long, text string"


def plain(docs, window):
    """doc_id, n_words, n_removed, kept words: each window is held against all of smaller ids."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            f = first.get(tuple(w[s : s + window]))
            if f is not None and (i is None or f < i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def hashed(rows):
    return sorted(((i, n, r, hashlib.sha256(k).hexdigest()) for i, n, r, k in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize(("window", "seed"), [(5, 1), (8, 2), (50, 3)])
def test_repeats_equal_brute_force(spark, window, seed):
    rnd = random.Random(seed)
    passages = [[rnd.choice("ab") if seed == 1 else f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(window - 2, 4 * window))] for _ in range(6)]
    docs = []
    for i in range(90):
        words = []
        for _ in range(rnd.randrange(4)):
            words += rnd.choice(passages)[rnd.randrange(3) : rnd.choice([None, -1, -2])] if rnd.random() < 0.6 else [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(3 * window))]
        docs.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([" ", "\n", "\t \r"]).join(words)))
    docs += docs[:5] + [(7, None), (None, ""), (200, " \n"), (-3, docs[10][1]), (300, docs[10][1])]
    want = hashed(plain(docs, window))
    assert sum(r[2] for r in want) > 0
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert got(substrings.repeats(df, window=window)) == want
    assert got(substrings.repeats(df, window=window, filter_bits=7)) == want  # a full bitmap changes nothing


def test_a_passage_in_many_documents_and_one_very_long_text(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, f"{' '.join(f'a{i}_{k}' for k in range(i % 30))} {passage} tail{i}") for i in range(300)]
    rnd = random.Random(5)
    long = " ".join(str(rnd.randrange(50_000)) for _ in range(400_000))
    docs += [(1000, long + " " + passage), (1001, "x" * 5000 + " " + long[100_000:900_000]), (1002, "y" * 3_000_000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert got(substrings.repeats(df)) == hashed(plain(docs, 50))


def test_ids_that_no_broadcast_holds(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = got(substrings.repeats(docs))
    monkeypatch.setattr(substrings, "MAX_BROADCAST_ROWS", -1)
    assert got(substrings.repeats(docs)) == want


def test_odd_tables(spark):
    assert substrings.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    words = " ".join(f"w{k}" for k in range(70))
    df = spark.createDataFrame([(1, words, 5), (2, "go " + words, None), (2, "\n a  b", 6), (None, None, 7), (3, words, 8)], "doc_id long, text string, row int")
    df = df.withColumn("h", F.lit("x")).withColumn("sha", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("p", F.lit(3))
    assert {(r.doc_id, r.n_removed) for r in substrings.repeats(df).collect()} == {(1, 0), (2, 70), (2, 0), (None, 0), (3, 70)}
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.row) for r in out.collect()), key=str) == sorted([(1, words, 5), (2, "go", None), (2, "\n a  b", 6), (None, None, 7), (3, "", 8)], key=str)


def test_word_keys_and_pieces(monkeypatch):
    text = ("é word\tword  lengthy-word-of-many-bytes\x0b" + "z" * 2000 + " word").encode()
    starts, keys = substrings._keys(text)
    assert [text[s:].split()[0] for s in starts] == text.split()
    assert keys[1] == keys[2] == keys[5] and len(set(keys.tolist())) == 4
    monkeypatch.setattr(substrings, "PIECE", 3)
    assert b"".join(substrings._pieces(text)) == text
    assert b"".join(substrings.kept_pieces(b"a b c d e f g", [1, 3, 4, 5])) == b"a d f g"
