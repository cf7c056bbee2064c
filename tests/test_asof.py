"""As-of joins against a plain search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mentionlab.operators import asof


def plain(left, right, forward):
    out = []
    for i, k, t in left:
        fit = [(s, v) for key, s, v in right if key is not None and s is not None and key == k and t is not None and (s >= t if forward else s <= t)]
        best = min(fit, key=lambda x: (x[0], x[1])) if forward and fit else None
        if not forward and fit:
            last = max(s for s, _ in fit)
            best = min(x for x in fit if x[0] == last)
        out.append((i, *(best or (None, None))))
    return sorted(out)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_equals_a_plain_search(spark, forward, ranges):
    rnd = random.Random(ranges)
    key = lambda: rnd.choice(["hot"] * 12 + ["a", "b", "c", None])
    left = [(i, key(), rnd.choice([rnd.randrange(200), rnd.randrange(200), None])) for i in range(300)]
    right = [(key(), rnd.choice([rnd.randrange(200), None]), f"v{rnd.randrange(5)}") for _ in range(60)]
    a = spark.createDataFrame(left, "id int, k string, t int").withColumn("_row", F.lit("x"))
    b = spark.createDataFrame(right, "k string, s int, v string")
    got = asof.asof_join(a, b, "k", "t", "s", ["v"], forward=forward, ranges=ranges)
    assert got.columns == ["id", "k", "t", "_row", "asof_time", "v"]
    assert sorted((r.id, r.asof_time, r.v) for r in got.collect()) == plain(left, right, forward)
    assert asof.asof_join(a, b.limit(0), "k", "t", "s", ["v"], forward=forward).where("v IS NOT NULL").count() == 0
    assert asof.asof_join(a.limit(0), b, "k", "t", "s", ["v"], forward=forward).count() == 0


def test_headline_versions(spark):
    day = lambda k, h=0: dt.datetime(2025, 1, k, h)
    articles = spark.createDataFrame([("u1", day(2), "crawl 1", "live 1"), ("u2", day(2), "crawl 2", "live 2"), ("u3", day(2), "", "live 3"), ("u4", day(2), None, None), (None, day(2), "c", "l")], "url string, published timestamp, crawled string, live string")
    snaps = spark.createDataFrame([("u1", day(1), "too early"), ("u1", day(3), ""), ("u1", day(4), "second"), ("u1", day(3, 5), "first"), ("u2", day(17), "too late"), ("u3", day(16), "in time"), ("u3", day(20), "later")], "url string, taken timestamp, headline string")
    got = {r.url: (r.headline, r.headline_source) for r in asof.headline_versions(articles, snaps).collect()}
    assert got == {"u1": ("first", "archive"), "u2": ("crawl 2", "crawl"), "u3": ("in time", "archive"), "u4": (None, None), None: ("c", "crawl")}
