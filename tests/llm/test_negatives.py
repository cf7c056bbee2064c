import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mentionlab.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchor):
    """Brute force over (vec_id, vector, label)."""
    kept = [(k, i, [math.floor(256 * x) for x in v], lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, lab in kept:
        if i is None or not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if j is None else j, m, other) for m, j, w, other in kept if m != k]
        scored.sort()
        for ps, pid, _, _ in [s for s in scored if s[3] == lab][:5]:
            fit = [s for s in scored if s[3] != lab and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, pid, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(math.inf if x is None else x for x in r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def rows_of(seed, n, dim, far):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, far) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, [float(int(64 * (x + rnd.gauss(0, 0.3)))) / 64 for x in c], rnd.randrange(4)))
    hot = rows[0][1]
    return rows + [(n + i, hot, i % 4) for i in range(n // 2)]  # one vector with a third of the rows


@pytest.mark.parametrize(("seed", "n", "dim", "far"), [(1, 120, 3, 2.0), (2, 400, 8, 4.0), (3, 200, 16, 0.1)])
def test_equals_brute_force(spark, monkeypatch, seed, n, dim, far):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 17)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 5)
    monkeypatch.setattr(negatives, "ASKED", 7)
    rows = rows_of(seed, n, dim, far)
    rows += [(7, None, 1), (10, [float("nan")] * dim, 1), (20, [None] + [0.0] * (dim - 1), 2), (30, [1.0] * dim, None), (None, rows[3][1], 0), (40, [float("inf")] * dim, 2), (50, [], 1), (60, [1.0], 1), (10, rows[5][1], 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 50
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == want


def test_bounds_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    seen = []
    run = negatives._Search._run
    monkeypatch.setattr(negatives._Search, "_run", lambda self, asks, pairs, k, same: (seen.append(pairs.count()), run(self, asks, pairs, k, same))[1])
    rows = rows_of(4, 600, 4, 30.0)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)
    own, others = seen[:2]
    blocks = len(rows) / 20
    assert own + others < 0.6 * 8 * blocks  # eight groups at least, a cell each


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert negatives.hard_negatives(one, F.lit(True)).count() == 0
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (2, [1.0], 2)], SCHEMA).withColumn("row", F.lit("x")).withColumn("anchor", F.lit(1)).withColumn("cell", F.lit(2))
    assert [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 512 * 256, 256 * 256)]
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9, 1e9], 1)], SCHEMA), F.lit(True))


def test_query_equals_its_sql_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    order = "SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM"
    assert got(negatives.op12_negatives(spark, sf)) == sorted(con.execute(f"{order} ({negatives.OP12_SQL})").fetchall())
