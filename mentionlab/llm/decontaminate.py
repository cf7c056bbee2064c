"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the test items. Words are the alphabet and a block is two consecutive words. For all
patterns of one length m the shift table has, for each block that occurs in one, its least distance from the pattern's
end; any other block lets the scan jump by m - 1 words, so most of a clean text is never compared. A block at distance 0
leads to a suffix bucket; the bucket's patterns are compared with the text directly. Items of fewer words than a window
are patterns of their own length, with tables of their own; patterns of one word are looked up word by word.

The tables are sent to the executors in chunks of at most chunk_words pattern words, counted beforehand: more test text
means more passes over the documents, never a larger broadcast. A chunk's occurrences are written and the chunk is
destroyed before the next one is sent, so executors hold one chunk at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.llm.common import fresh, numbered, table, written

WINDOW = 13
#: A document is contaminated if some word is hit and SHARE * hit words >= words.
SHARE = 20
#: Words of test items in one chunk: about 100 MB of tables.
CHUNK_WORDS = 500_000

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters; none for null."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class WuManber:
    """Search tables of one pattern length; patterns are tuples of m >= 2 words, with the items they come from."""

    def __init__(self, m: int, patterns: dict[tuple[str, ...], list[int]]):
        self.m, self.far = m, m - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.suffix: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        for p, items in patterns.items():
            for j in range(1, m):
                block, d = (p[j - 1], p[j]), m - 1 - j
                if d < self.shift.get(block, m):
                    self.shift[block] = d
            self.suffix.setdefault((p[-2], p[-1]), {})[p] = items

    def find(self, text: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence, in order."""
        m, far, shift, end, n = self.m, self.far, self.shift.get, self.m - 1, len(text)
        while end < n:
            block = (text[end - 1], text[end])
            d = shift(block, far)
            if d:
                end += d
                continue
            items = self.suffix[block].get(tuple(text[end - m + 1 : end + 1]))
            if items is not None:
                yield end - m + 1, items
            end += 1


class Matcher:
    """All patterns of some items; an item is (number, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW):
        by: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for k, w in items:
            m = min(window, len(w))
            for p in dict.fromkeys(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if m else ():
                by.setdefault(m, {}).setdefault(p, []).append(k)
        self.single = {p[0]: v for p, v in by.pop(1, {}).items()}
        self.tables = [WuManber(m, p) for m, p in sorted(by.items())]

    def hits(self, text: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint ascending ranges [start, end) of hit words, and the items that occur."""
        found, items = [], set()
        for t in self.tables:
            for start, of in t.find(text):
                found.append((start, start + t.m))
                items.update(of)
        if self.single:
            for i, w in enumerate(text):
                if w in self.single:
                    found.append((i, i + 1))
                    items.update(self.single[w])
        return union(found), items


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _chunks(items: DataFrame, item_id: str, text: str, chunk_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The test items in chunks of a bounded number of words (one item at least), read partition by partition."""
    chunk, n = [], 0
    for r in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        w = words(r.t)
        if not w:
            continue
        if chunk and n + len(w) > chunk_words:
            yield chunk
            chunk, n = [], 0
        chunk.append((r.i, w))
        n += len(w)
    if chunk:
        yield chunk


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, chunk_words: int = CHUNK_WORDS, names: list[str] | None = None) -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items, items_sha256, contaminated (or five other names).

    Null or empty texts have no words and are not contaminated; items without words are left out, an
    item without an id has the empty one; repeated items and
    repeated documents count each for itself (equal item ids once). The columns of docs stay as they are; a clash with
    the result's names must be avoided by giving other names.
    """
    spark = docs.sparkSession
    names = names or ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    chunks = _chunks(items, item_id, item_text, chunk_words)
    first = next(chunks, [])
    second = next(chunks, None)
    types = dict(zip(names, ("long", "long", "long", "string", "boolean")))
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{k}` {v}" for k, v in types.items())])

        def run(batches):
            matcher, ids = _matcher(shared, window)
            for batch in batches:
                rows = []
                for t in batch.column(text).to_pylist():
                    w = words(t)
                    ranges, found = matcher.hits(w)
                    hit, of = sum(b - a for a, b in ranges), {ids[k] for k in found}
                    rows.append((len(w), hit, len(of), digest(of), hit > 0 and share * hit >= len(w)))
                made = zip(*rows) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(made, kinds))], names=[*batch.schema.names, *names])

        return docs.mapInArrow(run, schema)

    (row,) = fresh(docs, "row")
    docs = numbered(docs, "decontaminate", row)
    only = docs.select(row, F.col(text).alias("text"))
    parts = [_part(only, row, first, window, True), _part(only, row, second, window, False), *(_part(only, row, chunk, window, False) for chunk in chunks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    of = F.array_sort(F.array_distinct(F.flatten(F.collect_list("of"))))
    whole = whole.groupBy(row).agg(F.max("n").alias("n"), F.flatten(F.collect_list("ranges")).alias("ranges"), of.alias("of"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], a["end"]))).alias("n"), F.greatest(a["end"], x["b"]).alias("end"))
    hit = F.aggregate(F.array_sort("ranges"), start, step, lambda a: a["n"])
    made = [F.col("n"), hit, F.size("of").cast("long"), F.sha2(F.array_join("of", ","), 256), (hit > 0) & (share * hit >= F.col("n"))]
    return docs.join(whole.select(row, *[c.alias(n) for c, n in zip(made, names)]), row).drop(row)


#: The last chunk's matcher of a worker, with the chunk it was made from.
_last: list[tuple[list, int, Matcher]] = []


def _matcher(shared, window: int) -> tuple[Matcher, list[str]]:
    """Search tables of a chunk and its items' ids; built once in a worker, which gets a broadcast's value once."""
    if not (_last and _last[0][0] is shared.value and _last[0][1] == window):
        _last[:] = [(shared.value, window, Matcher([(k, w) for k, (_, w) in enumerate(shared.value)], window))]
    return _last[0][2], [i for i, _ in shared.value]


def _part(docs: DataFrame, row: str, chunk: list, window: int, first: bool) -> DataFrame:
    """Occurrences of a chunk's items, written; rows without one are in the first part only."""
    shared = docs.sparkSession.sparkContext.broadcast(chunk)

    def run(batches):
        matcher, ids = _matcher(shared, window)
        for batch in batches:
            out = []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(t)
                ranges, found = matcher.hits(w)
                if first or ranges:
                    out.append({row: r, "n": len(w), "ranges": [{"a": a, "b": b} for a, b in ranges], "of": [ids[k] for k in found]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(row, pa.int64()), ("n", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("of", pa.list_(pa.string()))]))

    part = written(docs.mapInArrow(run, f"`{row}` long, n long, ranges array<struct<a: long, b: long>>, of array<string>"), "decontaminate-part")
    shared.destroy()
    return part


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs that are not contaminated, columns as they were."""
    names = fresh(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return scan(docs, items, text, names=names, **how).where(~F.col(names[4])).select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


OP7_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win
      FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
o AS (SELECT doc_id, k, m, item FROM (SELECT doc_id, k, l.m AS m, array_to_string(w[k:k + l.m - 1], ' ') AS win
        FROM d, (SELECT DISTINCT m FROM p) AS l, unnest(range(1, len(w) - l.m + 2)) AS u(k)) AS x JOIN p USING (m, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
