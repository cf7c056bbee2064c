"""Operator 13: exact substring dedup by fixed-block anchors.

A window of WINDOW words is a repeat if its words also start in a document with a smaller id. Any window holds a whole
block of BLOCK words that begins at a multiple of BLOCK, so it is enough to index these non-overlapping blocks of each
document and to look up every rolling BLOCK-word window of each text (a probe). A probe whose block lies in a document
with a smaller id is a hit, an anchor of possible repeats; further repeats of the two texts have anchors of their own, so
a hit is extended by at most BLOCK words to each side.

Hits are extended by content, not pair by pair: a passage that N documents share costs N rows, never N * N. First the
block and all BLOCK words on both sides are looked up together: inside long repeats one row settles all windows of an
anchor. Only anchors at a repeat's edges look up their windows one by one, with the windows around the same block in
other documents. Overlapping repeats are then merged to maximal spans.

Probes that cannot hit are dropped where they arise by a bitmap of block hashes of FILTER_BITS bits, whatever the data's
size. Once it is full (about 2 ** FILTER_BITS * BLOCK words) it drops less and a row for each word is shuffled; results
are the same. Equal texts are looked up once: of equal word sequences only the one with the least id is probed.

Words are compared by 64-bit keys, blocks and windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.llm.common import fresh, identified, released, table, text_of, written

WINDOW = 50
BLOCK = 25
#: Bits of the bitmap of block hashes that is sent to executors (32 MB).
FILTER_BITS = 28
#: Row numbers that are sent to executors as a filter, at most; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 300_000
#: Bytes of text that a worker looks at together.
PIECE = 1 << 21
#: Rows that a worker hands on together.
HANDED = 100_000
_NONE = hashlib.sha256(b"").hexdigest()
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are hashed one by one.
_LONG = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def _keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, keys): the byte where each word begins and a 64-bit key of its bytes."""
    raw = np.frombuffer(text + b" " * 8, np.uint8)
    space = _SPACE[raw]
    change = np.flatnonzero(np.diff(space)) + 1
    if not space[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[::2], change[1::2]
    size = ends - starts
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    key = _mixed(size.astype(_U) + _A)
    at = np.flatnonzero(size <= _LONG)
    done = 0
    while len(at):
        left = size[at] - done
        lane = eights[starts[at] + done] & np.where(left >= 8, ~_U(0), (_U(1) << (_U(8) * np.clip(left, 0, 7).astype(_U))) - _U(1))
        key[at] = _mixed((key[at] ^ lane) + _A)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > _LONG):
        key[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return starts, key


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _rolled(keys: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive keys, by doubling."""
    out, have, step, size, power = None, 0, keys, 1, base | 1
    while len(keys) >= n:
        if n & size:
            out = step if out is None else out[: len(keys) - have - size + 1] * _U(power) + step[have:]
            have += size
        if have == n:
            return _mixed(out)
        step = step[: len(step) - size] * _U(power) + step[size:]
        size, power = 2 * size, power * power & (1 << 64) - 1
    return np.zeros(0, _U)


def _batches(batches, columns: list[str]) -> Iterator[tuple[list[list], np.ndarray, np.ndarray]]:
    """(rows, bounds, keys): rows of some columns beside the text's (last in a batch), the word keys of their texts one after
    another, and where each row's begin and end. Short texts are taken together, long ones piece by piece."""
    for batch in batches:
        texts, rest = batch.column(batch.num_columns - 1), [batch.column(c) for c in columns]
        held, size = [], 0
        for i in range(batch.num_rows + 1):
            if held and (i == batch.num_rows or size + len(texts[i].as_buffer() or b"") > PIECE):
                yield _together(held, texts, rest)
                held, size = [], 0
            if i < batch.num_rows:
                held.append(i)
                size += len(texts[i].as_buffer() or b"")


def _together(held: list[int], texts, rest) -> tuple[list[list], np.ndarray, np.ndarray]:
    raw = [texts[i].as_py() for i in held]
    if len(raw) == 1 and len(raw[0]) > PIECE:
        keys = np.concatenate([_keys(p)[1] for p in _pieces(raw[0])])
        bounds = np.array([0, len(keys)])
    else:
        starts, keys = _keys(b"\n".join(raw))
        bounds = np.append(np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in raw[:-1]])), len(keys))
    return [[c[i].as_py() for c in rest] for i in held], bounds, keys


def _inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the positions 0 .. total - n begin n words of one text."""
    own = np.ones(max(total - n + 1, 0), bool)
    for b in bounds[1:-1]:
        own[max(b - n + 1, 0) : b] = False
    return own


def _blocks_of(keys: np.ndarray, bounds: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position: hash of a block there, whether it lies in one text, hash of it with both sides, whether these do."""
    total = len(keys)
    one = _rolled(keys, block, 0xD6E8FEB86659FD93)
    whole = _inside(bounds, block, total)
    around = np.zeros(len(one), _U)
    sides = np.zeros(len(one), bool)
    if total >= 3 * block:
        other = _rolled(keys, block, 0xA0761D6478BD642F)
        around[block : total - 2 * block + 1] = _mixed(_mixed(other[: total - 3 * block + 1] + _A) * _C + _mixed(other[2 * block :] + _C))
        sides[block : total - 2 * block + 1] = _inside(bounds, 3 * block, total)
    return one, whole, around, sides


_MARK = "h long, c long, doc_id long, row long, p int"


def _marked(kind: str, block: int, bitmap=None, bits: int = 0):
    """Blocks (kind index) or probes that may hit (kind probe) of texts: hash, hash with both sides, document, row, place."""

    def run(batches):
        for rows, bounds, keys in _batches(batches, ["row", "doc_id"]):
            one, whole, around, sides = _blocks_of(keys, bounds, block)
            if not len(one):
                continue
            if kind == "index":
                at = np.concatenate([np.arange(a, b - block + 1, block) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).astype(int)
            else:
                low = one & _U((1 << bits) - 1)
                at = np.flatnonzero(whole & ((bitmap.value[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1)).astype(bool))
            of = np.searchsorted(bounds, at, "right") - 1
            for k in range(0, len(at), HANDED):
                i, o = at[k : k + HANDED], of[k : k + HANDED]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[i].view(np.int64)), pa.array(around[i].view(np.int64), mask=~sides[i]), pa.array([rows[j][1] for j in o], pa.int64()), pa.array([rows[j][0] for j in o], pa.int64()), pa.array((i - bounds[o]).astype(np.int32))],
                    ["h", "c", "doc_id", "row", "p"],
                )

    return released(run)


def _bitmap(blocks: DataFrame, bits: int) -> np.ndarray:
    """The low bits of all block hashes as a bitmap: 2 ** (bits - 6) numbers at most, whatever the data's size."""
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = blocks.groupBy(F.shiftright(low, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), _U)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return out


_WINDOW = "w long, v long, doc_id long, row long, s int, probe boolean, known boolean"


def _windows(window: int, block: int):
    """The windows around edges (probes) and around blocks of the same content (known), by two hashes."""
    back = np.arange(window - block)

    def of(places: list[int] | None, n: int) -> np.ndarray:
        out = np.zeros(max(n - window + 1, 0), bool)
        if places:
            s = (np.array(places)[:, None] - back[None, :]).ravel()
            out[s[(s >= 0) & (s < len(out))]] = True
        return out

    def run(batches):
        for rows, bounds, keys in _batches(batches, ["row", "doc_id", "probes", "known"]):
            for (row, doc_id, probes, known), a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
                p, k = of(probes, b - a), of(known, b - a)
                at = np.flatnonzero(p | k)
                if not len(at):
                    continue
                w, v = (_rolled(keys[a:b], window, base)[at].view(np.int64) for base in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
                for j in range(0, len(at), HANDED):
                    i = slice(j, j + HANDED)
                    m = len(at[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[i]), pa.array(v[i]), pa.array([doc_id] * m, pa.int64()), pa.array([row] * m, pa.int64()), pa.array(at[i].astype(np.int32)), pa.array(p[at[i]]), pa.array(k[at[i]])],
                        ["w", "v", "doc_id", "row", "s", "probe", "known"],
                    )

    return released(run)


def _whole(batches):
    """row, doc_id, n_words and the digest of all words joined by one space."""
    for batch in batches:
        n_words, digests = [], []
        for t in batch.column(2):
            h, n = hashlib.sha256(), 0
            for piece in _pieces(t.as_py()):
                if words := piece.split():
                    h.update((b" " if n else b"") + b" ".join(words))
                    n += len(words)
            n_words.append(n)
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digests)], ["row", "doc_id", "n_words", "sha"])


def _merged(batches):
    """Maximal spans of the words that repeats cover: flat list of start, end; and how many words they hold."""
    for batch in batches:
        spans, removed = [], []
        for found in batch.column(1):
            flat, last = [], -1
            for code in sorted(found.as_py()):
                a, b = code >> 8, (code >> 8) + (code & 255)
                if a > last:
                    flat += [a, b]
                else:
                    flat[-1] = max(flat[-1], b)
                last = flat[-1]
            spans.append(flat)
            removed.append(sum(flat[1::2]) - sum(flat[::2]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(removed, pa.int64())], ["row", "spans", "n_removed"])


def kept_pieces(text: bytes, spans: list[int]) -> Iterator[bytes]:
    """The words outside the spans, joined by one space, piece by piece."""
    at, k, first = 0, 0, True
    for piece in _pieces(text):
        words, out, i = piece.split(), [], 0
        while i < len(words):
            while k < len(spans) and spans[k + 1] <= at + i:
                k += 2
            a, b = (spans[k], spans[k + 1]) if k < len(spans) else (at + len(words), 0)
            if a <= at + i:
                i = b - at
            else:
                out += words[i : min(a - at, len(words))]
                i = a - at
        at += len(words)
        if out:
            yield (b"" if first else b" ") + b" ".join(out)
            first = False


def _kept_digest(batches):
    for batch in batches:
        digests = []
        for spans, text in zip(batch.column(1), batch.column(2), strict=True):
            h = hashlib.sha256()
            for piece in kept_pieces(text.as_py(), spans.as_py()):
                h.update(piece)
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests)], ["row", "sha"])


def _kept_text(batches):
    for batch in batches:
        texts = [b"".join(kept_pieces(t.as_py(), s.as_py() or [])).decode() for s, t in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def _only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) some rows; their numbers are sent only if they are few."""
    return docs.join(F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows, "row", how)


def _smaller(first: str, doc_id: str):
    """Whether document `first` comes before document doc_id; a null id comes after all others."""
    return F.col(doc_id).isNull() | (F.col(first) < F.col(doc_id))


def _found(base: DataFrame, window: int, block: int, filter_bits: int) -> DataFrame:
    """row, spans, n_removed of texts (row, doc_id, text) that hold repeats."""
    spark = base.sparkSession
    blocks = written(base.mapInArrow(_marked("index", block), _MARK), "repeat-blocks")
    known = blocks.where("doc_id IS NOT NULL")
    bitmap = spark.sparkContext.broadcast(_bitmap(known, filter_bits))
    probes = base.mapInArrow(_marked("probe", block, bitmap, filter_bits), _MARK)
    # sums are written before they are joined: an exchange that feeds a join alone can be split where a block is hot
    firsts = written(known.groupBy("h").agg(F.min("doc_id").alias("first")), "repeat-firsts")
    fulls = written(known.where("c IS NOT NULL").groupBy("h", "c").agg(F.min("doc_id").alias("full_first")), "repeat-fulls")
    hits = probes.join(firsts, "h").where(_smaller("first", "doc_id"))
    hits = hits.join(fulls, ["h", "c"], "left").select("row", "p", "h", F.coalesce(F.col("full_first").isNotNull() & _smaller("full_first", "doc_id"), F.lit(False)).alias("whole"))
    hits = written(hits, "repeat-hits")
    bitmap.destroy()
    edges = hits.where("NOT whole")
    near = known.join(written(edges.select("h").distinct(), "repeat-live"), "h", "left_semi")
    places = edges.select("row", "p", F.lit(True).alias("probe")).unionByName(near.select("row", "p", F.lit(False).alias("probe")))
    places = written(places.groupBy("row").agg(F.collect_list(F.when(F.col("probe"), F.col("p"))).alias("probes"), F.collect_list(F.when(~F.col("probe"), F.col("p"))).alias("known")), "repeat-places")
    texts = _only(base, places.select("row"), "left_semi").join(places, "row").select("row", "doc_id", "probes", "known", "text")
    windows = written(texts.mapInArrow(_windows(window, block), _WINDOW), "repeat-windows")
    seen = windows.where("known AND doc_id IS NOT NULL").groupBy("w", "v").agg(F.min("doc_id").alias("first"))
    seen = written(seen, "repeat-seen")
    found = windows.where("probe").join(seen, ["w", "v"]).where(_smaller("first", "doc_id")).select("row", (F.col("s").cast("long") * 256 + window).alias("span"))
    inner = hits.where("whole").select("row", ((F.col("p") - block).cast("long") * 256 + 3 * block).alias("span"))
    spans = found.unionByName(inner).groupBy("row").agg(F.collect_list("span").alias("found"))
    return written(spans.mapInArrow(_merged, "row long, spans array<int>, n_removed long"), "repeat-spans")


def _judged(docs: DataFrame, text: str, doc_id: str, row: str, window: int, filter_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, spans, base): meta has row, doc_id, n_words, sha, gone (all words are removed) and twin (the row that has
    the same words and is judged); spans is of the judged rows, base their texts."""
    if not 4 <= window <= 80:  # spans keep their length in a byte
        raise ValueError("windows have 4 to 80 words")
    plain = docs.select(F.col(row).cast("long").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.encode(text_of(text), "utf-8").alias("text"))
    meta = written(plain.mapInArrow(released(_whole), "row long, doc_id long, n_words long, sha string"), "repeat-docs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = meta.where(F.col("n_words") >= window).groupBy("sha").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups, "repeat-groups")
    meta = meta.join(groups, "sha", "left")
    gone = F.coalesce(F.col("least.doc_id").isNotNull() & _smaller("least.doc_id", "doc_id"), F.lit(False))
    meta = written(meta.select("row", "doc_id", "n_words", "sha", gone.alias("gone"), F.coalesce("least.row", "row").alias("twin")), "repeat-meta")
    base = plain
    short = meta.where((F.col("n_words") < window) | (F.col("twin") != F.col("row"))).select("row")
    base = _only(base, short, "left_anti")
    block = window // 2
    return meta, _found(base, window, block, filter_bits), base


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word is removed if a window of `window` words of its document covers it whose words also start in a document with a
    smaller id. Ids are whole numbers; a null id comes after all others and two of them are not compared. Rows that repeat
    an id are judged each, and not against each other. Null and empty texts have no words; texts of any length are read
    piece by piece. An empty table gives an empty result. Other columns are not looked at.
    """
    docs, row = identified(docs, doc_id, "repeat-rows")
    meta, spans, base = _judged(docs, text, doc_id, row, window, filter_bits)
    part = spans.join(meta.select("row", "n_words"), "row").where("n_removed < n_words").select("row", "spans")
    texts = _only(base, part.select("row"), "left_semi").join(part, "row").select("row", "spans", "text")
    kept = texts.mapInArrow(released(_kept_digest), "row long, sha string").withColumnRenamed("sha", "part_sha")
    results = spans.select(F.col("row").alias("twin"), "n_removed").join(kept.withColumnRenamed("row", "twin"), "twin", "left")
    out = meta.where("gone").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_NONE).alias("kept_sha256"))
    rest = meta.where("NOT gone").join(results, "twin", "left")
    rest = rest.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.when(F.coalesce(F.col("n_removed"), F.lit(0)) == 0, F.col("sha")).otherwise(F.coalesce("part_sha", F.lit(_NONE))).alias("kept_sha256"))
    return out.unionByName(rest)


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with the text of each row that holds repeats replaced by its kept words, joined by one space; other rows and
    columns as they were. Odd rows are treated as in repeats()."""
    docs, row = identified(docs, doc_id, "repeat-rows")
    meta, spans, _ = _judged(docs, text, doc_id, row, window, filter_bits)
    hit = meta.where("NOT gone").join(spans.select(F.col("row").alias("twin"), "spans"), "twin").select("row", "spans")
    hit = hit.unionByName(meta.where("gone").select("row", F.array(F.lit(0), F.col("n_words").cast("int")).alias("spans")))
    own, new = fresh(docs, "hit_row", "hit_text")
    texts = docs.select(F.col(row).cast("long").alias("row"), F.encode(text_of(text), "utf-8").alias("text"))
    changed = texts.join(hit, "row").select("row", "spans", "text").mapInArrow(released(_kept_text), "row long, text string").select(F.col("row").alias(own), F.col("text").alias(new))
    out = docs.join(changed, F.col(row) == F.col(own), "left")
    names = [c for c in docs.columns if c != row]
    return out.select(*[F.coalesce(new, F.col(c)).alias(c) if c == text else F.col(c) for c in names])


def op13_substrings(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS k FROM g JOIN f USING (h) WHERE first < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
         ELSE coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
