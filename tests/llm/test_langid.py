import zlib

import numpy as np
import pytest

from mentionlab.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op5_langid(spark, sf_dir).collect()
    assert len(got) == len(docs)
    right = 0
    held = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.lang_pred == "und" or any(c.isalpha() for c in docs[r.doc_id].text or "")
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)


def grams(t):
    return {(n, t[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}


def plain_kernel(xs, zs):
    return np.array([[len(x & z) / np.sqrt(max(1, len(x)) * max(1, len(z))) for z in zs] for x in xs])


def test_kernel_is_presence_of_shared_ngrams():
    x, z = b"abcab", b"abd"
    work = langid.Grams()
    rows = [work.numbers(t) for t in (x, z)]
    assert len(rows[0]) == len(set(rows[0].tolist())) == len(grams(x))
    assert len(set(rows[0].tolist()) & set(rows[1].tolist())) == len(grams(x) & grams(z))
    assert len(work.numbers(b"")) == 0


def test_pieces_do_not_matter(monkeypatch):
    text = ("Ab, cd! É1 der die das " * 90 + "x" * 500).lower().encode()
    want = set(langid.Grams().numbers(text).tolist())
    monkeypatch.setattr(langid, "BATCH_BYTES", 64)
    assert set(langid.Grams().numbers(text).tolist()) == want and len(want) == len(grams(text))


def test_query_against_plain_kernel_ridge(spark, sf_dir):
    """The whole query against exact n-gram sets: one-versus-rest kernel ridge regression on the same landmarks, in its plain
    dual form on the Nystroem kernel K = K_xm K_mm^-1 K_mx."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    all_ = {r.doc_id: r for r in docs.collect()}
    taught = [d for d in all_ if zlib.crc32(str(d).encode()) % 5 and all_[d].lang is not None and all_[d].text and langid.has_letter(all_[d].text)]
    import hashlib

    key = {d: hashlib.md5(f"{d}:{hashlib.md5(all_[d].text.encode()).hexdigest()}".encode()).hexdigest() for d in taught}
    taught.sort(key=key.get)
    by = {}
    for d in taught:
        by.setdefault(all_[d].lang, []).append(d)
    langs = sorted(by)
    train = [d for d in taught if d in by[all_[d].lang][: langid.PER_LANGUAGE]]
    turn = [by[g][k] for k in range(max(map(len, by.values()))) for g in langs if k < len(by[g])]
    sets = {d: grams((r.text or "").lower().encode()) for d, r in all_.items()}
    marks = [sets[d] for d in turn[: langid.LANDMARKS]]
    x = [sets[d] for d in train]
    kmm, kxm = plain_kernel(marks, marks), plain_kernel(x, marks)
    inverse = np.linalg.pinv(kmm, rcond=1e-12)
    k = kxm @ inverse @ kxm.T
    y = np.where(np.array([all_[d].lang for d in train])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    n = len(train)  # the bias is not punished: dual system with a bordering row of ones
    system = np.block([[k + langid.RIDGE * n * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([y, np.zeros((1, len(langs)))]))
    got = {r.doc_id: r for r in langid.op5_langid(spark, sf_dir).collect()}
    same = 0
    ids = [d for d, r in all_.items() if r.text and langid.has_letter(r.text)]
    f = 4 * (plain_kernel([sets[d] for d in ids], marks) @ inverse @ kxm.T @ solved[:-1] + solved[-1])
    for d, v in zip(ids, f):
        e = np.exp(v - v.max())
        assert abs(got[d].score - e.max() / e.sum()) < 0.02
        same += got[d].lang_pred == langs[int(v.argmax())]
    assert same >= len(ids) - 1
    assert all(r.lang_pred == "und" for d, r in got.items() if d not in set(ids))


def test_sample_is_bounded_and_whole(spark):
    """One id that is most of the rows, equal rows, and more languages than landmarks."""
    rows = [(1, f"hot id number {i}", "en") for i in range(3000)] + [(2, "same row", "en")] * 3000 + [(10 + i, f"text {i} " + "lang " * (i % 7), f"l{i % 120:03}") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, per_language=50).collect()
    per = {}
    for r in got:
        per.setdefault(r.lang, []).append(r.text)
    assert len(per) == 121 and all(len(v) <= 50 for v in per.values()) and all(len(v) == 4 for k, v in per.items() if k != "en")
    assert len(set(per["en"])) == len(per["en"]) >= 30
    assert len(langid.fit(docs, per_language=50).langs) == 121


def test_long_texts_teach_whole(spark):
    """What tells two languages apart stands only at the end of long texts."""
    head = "common words for all " * 400
    train = spark.createDataFrame([(i, head + ("zzyx qqvk " * 100 if i % 2 else "ãõç ßüö " * 100) + str(i), "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, head + "zzyx qqvk " * 90), (2, head + "ãõç ßüö " * 90)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(train)).collect()] == ["a", "b"]


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "der die das und ist nicht " * 3 if i % 2 else "the of and that was with " * 3, "de" if i % 2 else "en") for i in range(40)] + [(99, None, "xx"), (98, "12", "yy"), (97, "w", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 -- _"), (4, "und nicht die der"), (4, "und nicht die der"), (5, "that was of the " * 50000), (6, "ß"), (None, "with and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert [g for g in got if g[0] != 6] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en"), (None, "en")]
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumn("Score", docs.doc_id), model)
    assert langid.predict(docs.withColumn("Score", docs.doc_id), model, names=("a", "b")).columns[-2:] == ["a", "b"]
    assert langid.predict(docs.limit(0), model).count() == 0
