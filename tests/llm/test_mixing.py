import pytest

from mentionlab.llm import mixing


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again, as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, None: 3}, {"a": 1}, {"b": 0, "a": 10, "é": 4, "z": 1000}, {"a": 0}, {"a": 900, "b": 800, "c": 1}, {f"s{i:02}": (i * 37) % 23 * 10 for i in range(20)}, {f"s{i:02}": 2 ** (i % 9) for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_budget_and_reruns(spark, sf_dir):
    a = mixing.op10_mixing(spark, sf_dir).collect()
    b = mixing.op10_mixing(spark, sf_dir).collect()
    assert sorted(a) == sorted(b)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    most = max(r["size"] for r in a)
    for s in set(docs.values()):
        rows = [r for r in a if docs[r.doc_id] == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= most
        assert all(r.taken <= 3 * r["size"] for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x", "b"), (4, "w " * 50000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS range")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 50000)]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_many_ranges(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    a = sorted(mixing.mix(docs, rows_per_range=10).collect())
    b = sorted(mixing.mix(docs).collect())
    assert a == b


def test_repeated_and_null_ids_lose_no_words(spark):
    """What comes out of each source is what the mix takes, whatever the ids are, with budgets that cut."""
    rows = [(None, f"{'w ' * (i % 5 + 12)}n{i}", "a") for i in range(40)] + [(7, f"{'v ' * (i % 3 + 2)}m{i}", "b") for i in range(40)] + [(5, "same text", "c")] * 60 + [(None, None, "c"), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS _row", "3 AS copies", "4 AS _mix_row")
    for weights in ((1, 2, 3), (1, 30, 1), (9, 1, 2)):
        told = mixing.mix(docs, weights=weights).collect()
        out = mixing.mixed_documents(docs, weights=weights)
        assert out.columns == docs.columns
        got = out.collect()
        for s in ("a", "b", "c"):
            taken = sum(r.taken for r in told if r.source == s)
            target = next(r.target for r in told if r.source == s)
            assert taken == sum(len((r.text or "").split()) for r in got if r.source == s)
            assert 0 < taken and abs(taken - target) <= 17
        assert sorted(str(r) for r in mixing.mix(docs, weights=weights).collect()) == sorted(map(str, told))


def test_hot_source_spreads(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'w w' AS text", "if(id % 10 < 9, 'hot', 'b') AS source")
    got = mixing.mix(docs, rows_per_range=10**9).collect()
    assert sum(r.taken for r in got if r.source == "hot") == pytest.approx(next(r.target for r in got if r.source == "hot"), abs=2)
