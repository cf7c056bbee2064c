"""Every query that has SQL is held against it on small tables."""

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted(([clean(v[i]) for i in order] for v in values), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() == 1
    assert set(registry.oracle_sql()) <= set(registry.queries())
