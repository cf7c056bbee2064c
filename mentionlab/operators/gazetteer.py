"""Places and casualties in the linkage of articles: names found by one automaton, pairs kept if place and count agree."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.session import written

#: Names in one automaton at most (about 100 MB): a larger gazetteer takes more passes over the texts.
MAX_NAMES = 200_000
#: Places farther apart are different ones; the mean radius of the earth.
NEAR_KM, EARTH_KM = 30.0, 6371.0088


class Finder:
    """Place names in a text: an Aho-Corasick automaton over lower-cased names. A name counts between characters that are no
    letters or digits, and not inside a longer name that counts too."""

    def __init__(self, names: list[str]):
        self.automaton = ahocorasick.Automaton()
        for n in names:
            self.automaton.add_word(n, n)
        if names:
            self.automaton.make_automaton()
        self.some = bool(names)

    def find(self, text: str | None) -> list[tuple[int, str]]:
        """(start, name), in order."""
        if not text or not self.some:
            return []
        text = text.lower()
        spans = []
        for end, name in self.automaton.iter(text):
            start = end - len(name) + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                spans.append((start, end + 1, name))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out, reach = [], -1
        for start, end, name in spans:
            if end > reach:
                out.append((start, name))
                reach = end
        return out


def _chunks(names: DataFrame) -> Iterator[list[str]]:
    chunk: list[str] = []
    for r in names.toLocalIterator():
        chunk.append(r.name)
        if len(chunk) == MAX_NAMES:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def mentions(docs: DataFrame, places: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, place_id, n): how often each place(place_id, name, ...) is named in each text. A name of several places counts
    for each. Names are trimmed and lower-cased; null and empty ones are left out. Names inside longer ones of another
    chunk of the gazetteer count."""
    keyed = places.select("place_id", F.lower(F.trim("name")).alias("name")).where("name <> ''")
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    found = None
    for names in _chunks(keyed.select("name").distinct().orderBy(F.length("name").desc(), "name")):
        finder = docs.sparkSession.sparkContext.broadcast(names)

        def run(batches, finder=finder):
            own = Finder(finder.value)
            for b in batches:
                rows = [(i, name) for i, t in enumerate(b.column(1)) for _, name in own.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([n for _, n in rows], pa.string())], ["doc", "name"])

        part = written(texts.mapInArrow(run, f"doc {kind}, name string").groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n")), "places")
        finder.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        found = texts.sparkSession.createDataFrame([], f"doc {kind}, name string, n long")
    return found.join(keyed, "name").groupBy("doc", "place_id").agg(F.sum("n").alias("n"))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def located(docs: DataFrame, named: DataFrame, places: DataFrame, casualties: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, spots, casualties): for each document the points of its places and its count of casualties."""
    points = named.join(places.select("place_id", F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("spot")), "place_id")
    points = points.where("spot.lat IS NOT NULL AND spot.lon IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_set("spot")).alias("spots"))
    own = docs.select(F.col(doc).alias("doc"), casualties.alias("casualties"))
    return own.join(points, "doc", "left")


def agreeing(pairs: DataFrame, facts: DataFrame, near_km: float = NEAR_KM, tolerance: int = 0) -> DataFrame:
    """The pairs (a, b, ...) that place and casualties let be one incident: some places of theirs are at most near_km apart,
    and their counts differ by `tolerance` at most. What a side does not know excludes nothing."""
    left = pairs.join(facts.select(F.col("doc").alias("a"), F.col("spots").alias("sa"), F.col("casualties").alias("ca")), "a", "left")
    both = left.join(facts.select(F.col("doc").alias("b"), F.col("spots").alias("sb"), F.col("casualties").alias("cb")), "b", "left")
    close = F.exists("sa", lambda p: F.exists("sb", lambda q: kilometres(p["lat"], p["lon"], q["lat"], q["lon"]) <= near_km))
    unknown = F.col("sa").isNull() | F.col("sb").isNull()
    count = F.col("ca").isNull() | F.col("cb").isNull() | (F.abs(F.col("ca") - F.col("cb")) <= tolerance)
    return both.where((unknown | close) & count).select(*pairs.columns)
