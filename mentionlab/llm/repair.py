"""Operator 11: repair of conversations by composed weighted transducers.

Three machines are composed: the input acceptor (a conversation's rows in order), an edit transducer (keep, rerole, delete,
insert) and the acceptor of the role grammar (s?(ua)+)?. Their product is never built: from a state (row, insertions made
before it, grammar state) the arcs that leave it are made when the search gets there. States are taken in topological
order, and weights are pairs (cost, label string) that add component by component and compare lexicographically. At a
state two labels of equal cost never begin one another (the label decides the state), so the order holds when both
grow, and the best path is found by keeping one weight for each state.

Conversations of any length are spread: rows are laid out by ranges of (conversation, turn), cut into chunks of at most
CHUNK rows of one conversation, and each chunk is searched from every grammar state. Chunks are then combined in order, one
weight for each grammar state, which needs their labels only (about four bytes a row), and the best path is handed back
to the chunks, where it becomes edits of rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.llm.common import SPACES, table, written

#: Rows of one conversation that are searched together.
CHUNK = 1024
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Arcs of the role grammar, by state and role initial; 0 is the start, 0 and 3 accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTS = (0, 1, 2, 3), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Insertions before one row: more would come back to a grammar state at a higher cost.
INSERTED = 2
_EMPTY = hashlib.sha256(b"").hexdigest()

Weight = tuple[int, str]


def arcs(codes: tuple[str, ...], i: int, inserted: int, g: int) -> Iterator[tuple[tuple[int, int, int], int, str]]:
    """Arcs of the composed machine that leave a state: (state, cost, label). A code is a row's fault (b blank, d duplicate,
    t truncated, o none) and its role's initial."""
    if inserted < INSERTED:
        for role in ROLES:
            if (g, role) in GRAMMAR:
                yield (i, inserted + 1, GRAMMAR[g, role]), INSERT, "I"
    if i == len(codes):
        return
    fault, initial = codes[i][0], codes[i][1:]
    yield (i + 1, 0, g), DELETE, "D"
    if fault in "bd":
        return
    more = TRUNCATED if fault == "t" else 0
    if (g, initial) in GRAMMAR:
        yield (i + 1, 0, GRAMMAR[g, initial]), more, "K"
    for role in ROLES:
        if (g, role) in GRAMMAR:
            yield (i + 1, 0, GRAMMAR[g, role]), REROLE + more, "R"


@functools.lru_cache(maxsize=20_000)
def shortest(codes: tuple[str, ...], start: int) -> dict[int, Weight]:
    """The best weight of each grammar state after all rows, from one before them."""
    column: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    for i in range(len(codes) + 1):
        after: dict[tuple[int, int], Weight] = {}
        for inserted in range(INSERTED + 1):
            for g in STATES:
                if (inserted, g) not in column:
                    continue
                cost, label = column[inserted, g]
                for (j, n, to), c, x in arcs(codes, i, inserted, g):
                    here, weight = column if j == i else after, (cost + c, label + x)
                    if (n, to) not in here or weight < here[n, to]:
                        here[n, to] = weight
        if i < len(codes):
            column = after
    return {g: min(w for (_, to), w in column.items() if to == g) for g in {to for _, to in column}}


def edits(label: str, g: int, codes: tuple[str, ...]) -> Iterator[tuple[str, int, str | None]]:
    """(edit, row, new role) along a label from a grammar state; an insertion has the row before which it comes."""
    i = 0
    for x in label:
        role = None
        if x in "IR":
            (first,) = {r for r in ROLES if (g, r) in GRAMMAR}
            role = ROLES[first]
        if x != "D":
            g = GRAMMAR[g, first if role else codes[i][1:]]
        yield x, i, role
        i += x != "I"


def _chunked(most: int):
    """Numbers the chunks of a sorted partition and the rows in them."""

    def run(batches):
        task, key, chunk, n = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            chunks, places = [], []
            for k in batch.column(0).to_pylist():
                if k != key or n == most:
                    key, chunk, n = k, chunk + 1, 0
                chunks.append((task << 32) + chunk)
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int32())], [*batch.schema.names, "chunk", "i"])

    return run


_PATH = "k string, chunk long, no int, start int, label string, codes array<string>, cost long, illegal long"


def _combined(batches):
    """Chunks of whole conversations in order: the best path's label in each; cost and illegal pairs beside the first."""
    key, held, vector, illegal, last = None, [], {}, 0, None

    def ended():
        goal = min((vector[g], g) for g in ACCEPTS if g in vector)[1]
        cost, g, labels = vector[goal][0], goal, []
        for chunk, codes, back in reversed(held):
            start, label = back[g]
            labels.append((chunk, codes, start, label))
            g = start
        labels.reverse()
        for at in range(0, len(labels), 256):
            part = labels[at : at + 256]
            no = range(at, at + len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(part)), pa.array([p[0] for p in part], pa.int64()), pa.array(list(no), pa.int32()), pa.array([p[2] for p in part], pa.int32()), pa.array([p[3] for p in part]), pa.array([list(p[1]) for p in part], pa.list_(pa.string())),
                 pa.array([None if k else cost for k in no], pa.int64()), pa.array([None if k else illegal for k in no], pa.int64())],
                ["k", "chunk", "no", "start", "label", "codes", "cost", "illegal"],
            )

    for batch in batches:
        for k, chunk, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if held:
                    yield from ended()
                key, held, vector, illegal, last = k, [], {0: (0, "")}, 0, None
            codes = tuple(f["code"] for f in found)
            pairs = [*([last] if last is not None else []), *(c[1:] for c in codes)]
            illegal += sum(a + b not in LEGAL for a, b in zip(pairs, pairs[1:], strict=False))
            last = pairs[-1]
            best: dict[int, tuple[Weight, int, str]] = {}
            for g, (cost, label) in vector.items():
                for to, (c, x) in shortest(codes, g).items():
                    if to not in best or (cost + c, label + x) < best[to][0]:
                        best[to] = ((cost + c, label + x), g, x)
            vector = {to: w for to, (w, _, _) in best.items()}
            held.append((chunk, codes, {to: (g, x) for to, (_, g, x) in best.items()}))
    if held:
        yield from ended()


def _edited(batches):
    for batch in batches:
        for k, chunk, no, start, label, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out = list(edits(label, start, tuple(codes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(out), pa.string()), pa.array([chunk] * len(out), pa.int64()), pa.array([(no << 32) + s for s in range(len(out))], pa.int64()), pa.array([x for x, _, _ in out], pa.string()), pa.array([i if x != "I" else None for x, i, _ in out], pa.int32()), pa.array([r for _, _, r in out], pa.string())],
                ["k", "chunk", "position", "edit", "i", "new_role"],
            )


def _digested(batches):
    """Of sorted rows: the digest of role:text of each conversation, joined by line feeds."""
    key, h = None, None
    for batch in batches:
        done = []
        for k, role, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            k = k.as_py()
            if k != key:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(role.as_py().encode() + b":")
            h.update(text.as_buffer() or b"")
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["k", "sha"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([h.hexdigest()])], ["k", "sha"])


def _key(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("none"))


class Repair:
    """The repair of a table of conversation rows: `rows` (faults beside each row), `paths`, `repaired` rows, `summary`.

    A null role or text is one space. Rows are taken by turn, nulls first, rows of one turn by role and digest of text.
    Null conversation ids are one conversation. Repeated rows are duplicates; an empty table has empty results. Texts are
    never looked at in Python but for digests; other columns of the table are not looked at.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK):
        self.ids = rows.select(F.col(conv).alias("conv_id"), _key(conv).alias("k")).distinct()
        own = rows.select(_key(conv).alias("k"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
        own = written(own.withColumn("digest", F.md5("text")).withColumn("uid", F.monotonically_increasing_id()), "repair-input")
        place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "uid")
        firsts = own.groupBy("k", "role", "digest").agg(F.min(place).alias("first"))
        last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
        fault = F.when(last == "", "b").when(place > F.col("first"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("o")
        judged = own.join(firsts, ["k", "role", "digest"]).select("k", "turn", "role", "text", "digest", "uid", F.concat(fault, F.left("role", F.lit(1))).alias("code"))
        tasks = self.tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ("k", F.col("turn").asc_nulls_first(), "role", "digest", "uid")
        laid = judged.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("k", "turn", "role", "text", "code")
        self.rows = written(laid.mapInArrow(_chunked(chunk), "k string, turn long, role string, text string, code string, chunk long, i int"), "repair-rows")
        chunks = self.rows.groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("found"))
        paths = chunks.repartition(tasks, "k").sortWithinPartitions("k", "chunk").select("k", "chunk", "found")
        self.paths = written(paths.mapInArrow(_combined, _PATH), "repair-paths")

    @property
    def repaired(self) -> DataFrame:
        """conv_id, position (grows along a conversation), edit, turn (null if inserted), role, text of the rows that stay."""
        return self._repaired().join(self.ids, "k").select("conv_id", "position", "edit", "turn", "role", "text")

    def _repaired(self) -> DataFrame:
        done = self.paths.select("k", "chunk", "no", "start", "label", "codes").mapInArrow(_edited, "k string, chunk long, position long, edit string, i int, new_role string").where("edit <> 'D'")
        rows = self.rows.select("k", "chunk", "i", "turn", "role", "text")
        joined = done.join(rows, ["k", "chunk", "i"], "left")
        return joined.select("k", "position", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    @property
    def summary(self) -> DataFrame:
        """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        fault = lambda x, name: F.count_if(F.col("code").startswith(x)).alias(name)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        counts = self.rows.groupBy("k").agg(gaps, fault("b", "blank"), fault("d", "duplicate"), fault("t", "truncated"))
        labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "label"))), lambda x: x["label"]), "").alias("audit")
        paths = self.paths.groupBy("k").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), labels)
        digests = self._repaired().repartition(self.tasks, "k").sortWithinPartitions("k", "position").select("k", "role", "text").mapInArrow(_digested, "k string, sha string")
        out = self.ids.join(counts, "k", "left").join(paths, "k", "left").join(digests, "k", "left")
        longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(_EMPTY)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage: rows dropped, emptied, without sentence marks, repeated or given the role user by a hash of their
    conversation and turn. Null values are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "utf-8")) % 20
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.alias("copy")).drop("copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = Repair(damaged(rows))
    repair.ids = rows.select("conv_id", _key("conv_id").alias("k")).distinct()
    return repair.summary


OP11_SQL = r"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
d AS (SELECT *, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, len(name) + 1), lambda j: [ascii(name[j])::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1::UBIGINT)))) % 20 AS kind FROM n),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS mark FROM e),
c AS (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN mark = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault FROM r),
p AS (
  SELECT conv_id, 0::BIGINT AS i, [{'g': 0, 'c': 0, 'l': '', 'o': []::VARCHAR[]}, {'g': 2, 'c': 5, 'l': 'I', 'o': ['user:']}, {'g': 3, 'c': 10, 'l': 'II', 'o': ['user:', 'assistant:']}] AS s FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL
  SELECT conv_id, i, list_filter([list_min(list_filter(z, lambda v: v.g = 0)), list_min(list_filter(z, lambda v: v.g = 1)), list_min(list_filter(z, lambda v: v.g = 2)), list_min(list_filter(z, lambda v: v.g = 3))], lambda v: v IS NOT NULL) AS s
  FROM (SELECT conv_id, i, list_concat(y, list_transform(list_filter(y, lambda v: v.g IN (0, 1, 2, 3)), lambda v: {'g': CASE v.g WHEN 2 THEN 3 ELSE 2 END, 'c': v.c + 5, 'l': v.l || 'I', 'o': list_append(v.o, CASE v.g WHEN 2 THEN 'assistant:' ELSE 'user:' END)})) AS z
  FROM (SELECT conv_id, i, list_concat(m, list_transform(m, lambda v: {'g': CASE v.g WHEN 2 THEN 3 ELSE 2 END, 'c': v.c + 5, 'l': v.l || 'I', 'o': list_append(v.o, CASE v.g WHEN 2 THEN 'assistant:' ELSE 'user:' END)})) AS y
  FROM (SELECT conv_id, i, list_concat(list_concat(
      list_transform(s, lambda v: {'g': v.g, 'c': v.c + 2, 'l': v.l || 'D', 'o': v.o}),
      list_transform(list_filter(s, lambda v: fault NOT IN ('b', 'd') AND ((x = 's' AND v.g = 0) OR (x = 'u' AND v.g <> 2) OR (x = 'a' AND v.g = 2))),
        lambda v: {'g': CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': v.c + CASE fault WHEN 't' THEN 5 ELSE 0 END, 'l': v.l || 'K', 'o': list_append(v.o, role || ':' || text)})),
      list_transform(list_filter(s, lambda v: fault NOT IN ('b', 'd')),
        lambda v: {'g': CASE v.g WHEN 2 THEN 3 ELSE 2 END, 'c': v.c + CASE fault WHEN 't' THEN 6 ELSE 1 END, 'l': v.l || 'R', 'o': list_append(v.o, CASE v.g WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)})) AS m
    FROM (SELECT p.conv_id, c.i, p.s, c.fault, c.x, c.role, c.text FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = p.i + 1))))),
w AS (SELECT conv_id, list_min(list_transform(list_filter(s, lambda v: v.g IN (0, 3)), lambda v: {'c': v.c, 'l': v.l, 'o': v.o})) AS b FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.l, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q LEFT JOIN k ON q.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN w ON q.conv_id IS NOT DISTINCT FROM w.conv_id
"""
