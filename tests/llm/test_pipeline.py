from collections import Counter

import corpus_pipeline
from mentionlab.llm import mixing
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_quality import brute as counts
from tests.llm.test_simhash import brute_components, plain
from tests.llm.test_tokens import expected


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], sf_dir), "test"))
    rows = [[tuple(r) for r in df.collect()] for df in seen]
    assert all(df.columns == docs.columns for df in seen[:-1])
    col = {c: i for i, c in enumerate(docs.columns)}
    text = lambda r: r[col["text"]]

    start, rated, unique, clean, mixed, out = rows
    failed = {r[0] for r in start if (c := counts(text(r)))[0] < 50 or 100 * c[4] > 50 * c[0]}
    kept = {r[0] for r in rated}
    assert not kept & failed
    good = {r[0] for r in start if labels.get(r[0]) == 1} - failed
    assert len(good - kept) <= 0.02 * len(good) + 1

    pairs = [(r[0], plain(text(r))) for r in rated]
    reps = brute_components(pairs)
    assert {r[0] for r in unique} <= set(reps.values())
    shingles = {r[0]: {tuple(w[i : i + 5]) for w in [text(r).lower().split()] for i in range(max(1, len(w) - 4))} for r in rated}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    gone = {d for d, _ in reps if d not in {r[0] for r in unique}}
    assert all(max(like(d, o) for o in shingles if o != d) > 0.5 for d in gone)
    assert all(like(a, b) < 0.9 for a in (r[0] for r in unique) for b in (r[0] for r in unique) if a < b)
    assert {r[0] for r in clean} == {r[0] for r in unique if not contamination(text(r), items)[4]}

    taken = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert Counter(r[0] for r in mixed) == Counter({k: v for k, v in taken.items() if v})
    assert sorted(out) == sorted(e[:4] for e in expected([(r[0], text(r)) for r in mixed]))


def test_odd_rows(spark, sf_dir):
    """Stages take null, empty, long and repeated rows, clashing columns and empty tables."""
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, long, "en", None, 1), (3, long, "en", None, 1), (4, long.upper(), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS n_words", "'x' AS key", "2 AS size")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(stage(spark, now, sf_dir), "test")
            assert now.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
        assert {r.doc_id for r in last} <= {3, 4}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() is not None
