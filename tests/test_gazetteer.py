"""Place names by automaton, and the linkage's constraints, against plain loops."""

import math
import random
import re

from mentionlab.operators import gazetteer

NAMES = ["bay", "byron bay", "sun", "sunbury", "st. kilda", "kilda", "north", "north byron bay", "é"]


def plain(text):
    """Longest names first, each place of the text taken once."""
    found, left = {}, text.lower()
    for name in sorted(NAMES, key=len, reverse=True):
        pattern = rf"(?<![^\W_]){re.escape(name)}(?![^\W_])"
        if n := len(re.findall(pattern, left)):
            found[name] = n
        left = re.sub(pattern, lambda m: "\0" * len(m[0]), left)
    return found


def test_mentions_equal_plain_search(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["Byron", "bay", "Bay", "Sun", "sunbury", "St.", "Kilda", "north", "crash", "at", "é", "Bays"]
    texts = [(i, rnd.choice([" ", " ", "-", ", "]).join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for i in range(200)] + [(900, None), (901, ""), (902, "bay " * 20_000)]
    places = spark.createDataFrame([(i, f" {n.upper()} ") for i, n in enumerate(NAMES)] + [(50, "sun"), (51, None), (52, "")], "place_id long, name string")
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {(r.doc, r.place_id): r.n for r in gazetteer.mentions(df, places).collect()}
    want = {(i, p): n for i, t in texts if t for name, n in plain(t).items() for p in ([NAMES.index(name), 50] if name == "sun" else [NAMES.index(name)])}
    assert got == want
    assert gazetteer.mentions(df, places.limit(0)).count() == 0


def test_place_and_casualties_decide(spark):
    facts = spark.createDataFrame([("a", [(-37.8, 145.0)], 1), ("b", [(-37.9, 145.1)], 2), ("c", [(-33.9, 151.2), (-37.8, 145.0)], None), ("d", None, 5), ("e", [(-33.9, 151.2)], 1)], "doc string, spots array<struct<lat: double, lon: double>>, casualties int")
    pairs = spark.createDataFrame([(x, y, 1) for x in "abcde" for y in "abcdef" if x < y], "a string, b string, z int")
    got = {(r.a, r.b) for r in gazetteer.agreeing(pairs, facts, near_km=30, tolerance=1).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), *((x, "f") for x in "abcde")}
    one = spark.range(1).select(gazetteer.kilometres(*[gazetteer.F.lit(x) for x in (0.0, 0.0, 0.0, 90.0)])).first()[0]
    assert math.isclose(one, gazetteer.EARTH_KM * math.pi / 2)
