"""Operator 4: SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits from the XXH64 (seed 42) of word shingles. Distinct fingerprints are linked where at most
max_bits bits differ, and documents take the least doc_id of their component.

Pairs to be looked at come from an exact split: the 64 bits are cut into `blocks` parts; two fingerprints that differ
in max_bits places agree in at least blocks - max_bits whole parts, so they share the key of some choice of that many
parts. Fingerprints are range-sorted by (choice, key, fingerprint): a key with very many fingerprints spreads over
several tasks instead of filling one. Within a key the Hamming distances to PIVOTS reference fingerprints form a
table; by the triangle inequality a pair whose coordinates differ by more than max_bits anywhere cannot be a link, so
coordinates are compared one pivot after another and only survivors are verified bit by bit. A pivot halves random
pairs at best (distances of random 64-bit strings concentrate at 32 +- 4), which is why the tables filter pairs inside
a key and don't choose the keys.

Every task returns a spanning forest of the links it found, not the pairs: what is kept of a group of n close
fingerprints is less than n rows for each choice of parts.

The corpus pipeline links these and, by a looser rule, sets of five-word shingles with a Jaccard similarity of 0.8 or
more. Candidates share a key of min-hashes and are close in a fingerprint of one bit of each; how often depends on their
similarity alone, not on where they differ. Every link is then verified on the shingles. Where a key holds very many
candidates, those nearest to each other are verified first. What lies between different components of these is compared
in cells of two tiles that hold the shingles themselves: a cell counts the common shingles of all its pairs by a matrix
product and returns a spanning forest, so what is written does not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import forget, fresh, identified, released, table, written
from mentionlab.operators.components import connected_components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Parts of the fingerprint: 20 choices of 3 of 6 parts, keys of 31 to 33 bits.
BLOCKS = 6
#: Fingerprints of one key that are compared in one piece; longer keys are cut into tiles of at most this many.
TILE = 2048
#: Ids of dropped documents that are sent to executors; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000
#: Rows of whole keys that a task holds at once.
HELD = 40_000
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, seed=SEED) for i in range(16)], dtype=np.uint64)


#: The looser rule: words of a shingle, and least similarity as a fraction.
LOOSE_SHINGLE, LEAST = 5, (4, 5)
#: Min-hashes, 64 for each word of a fingerprint; the first BANDS * BAND of them are keys of BAND each. Of pairs with
#: similarity 0.8, (1 - 0.8 ** 5) ** 32 = 3e-6 share no key; of their bits a tenth differs, and about 1e-6 of the pairs
#: differ in more than LOOSE_BITS. Both fall fast above 0.8.
WIDE, BANDS, BAND, LOOSE_BITS = 4, 32, 5, 50
#: Candidates of one key for each of its rows, beyond which only the nearest ones are looked at first.
CROWD = 4
#: Weight of a tile of a crowd: a row counts its shingles and CELL_ROW. Columns of a cell's matrices at once.
CELL, CELL_ROW, CELL_COLUMNS = 200_000, 200, 2048
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"min %d" % i, seed=SEED) | 1 for i in range(64 * WIDE)], dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, in order; a text of fewer words is one shingle, none without a word."""
    words = text.lower().split()  # for bytes: A-Z, and exactly the ASCII white space of the word rule
    n = len(words) - shingle + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text; 0 if it has no word."""
    h = shingle_hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def min_hashes(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingle hashes: WIDE words of one bit of each min-hash, and BANDS keys."""
    least = np.full(64 * WIDE, ~np.uint64(0))
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * MULTIPLIERS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    words = np.packbits(mixed >> np.uint64(63) > 0).view(np.uint64)
    keys = [xxhash.xxh64_intdigest(k.tobytes(), SEED) for k in least[: BANDS * BAND].reshape(BANDS, BAND)]
    return words, np.array(keys, np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp as signed 64-bit) for each row of docs; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(released(run), f"doc_id {kind}, fp long")


def shingled(docs: DataFrame, row: str, text: str = "text", doc_id: str = "doc_id", shingle: int = LOOSE_SHINGLE) -> DataFrame:
    """(row, doc_id, exact, node, fp, fp1, ..., keys) for each row of docs: what tells it apart, the 64-bit fingerprint, a
    digest of the text's set of shingles, and its min-hashes. Null text is empty."""
    names = ["fp", *(f"fp{k}" for k in range(1, WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                b = batch.slice(at, 250)
                texts = [t or b"" for t in b.column(2).to_pylist()]
                exact = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                made = [min_hashes(x) for x in sets]
                fps = np.array([m[0] for m in made], np.uint64).view(np.int64)
                columns = [b.column(0), b.column(1), pa.array(exact), pa.array(_nodes(sets)), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(WIDE)), _lists([m[1] for m in made])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "exact", "node", *names, "keys"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (row, doc_id)]
    schema = f"row {kinds[0]}, doc_id {kinds[1]}, exact long, node long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>"
    return docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(released(run), schema)


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)


def _lists(xs: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs).view(np.int64)))


def shingle_sets(texts: DataFrame, shingle: int = LOOSE_SHINGLE) -> DataFrame:
    """(node, shingles) of texts(t): sets of shingles, sorted, and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                sets = [np.unique(shingle_hashes(t or b"", shingle)) for t in batch.slice(at, 250).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets)), _lists(sets)], names=["node", "shingles"])

    return texts.select("t").mapInArrow(released(run), "node long, shingles array<long>")


def masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Bits of each choice of blocks - max_bits parts, as signed 64-bit numbers."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    found = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        up = self.up
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a == b:
            return False
        up[max(a, b)] = min(a, b)
        return True

    def find(self, a: int) -> int:
        while self.up[a] != a:
            a = self.up[a]
        return a


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """Pivot distance table: one row of Hamming distances for each reference fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int16) for p in PIVOTS])


def survivors(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int, other: np.ndarray | None = None, other_table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that are links: coordinates first, pivot by pivot, then the bits themselves."""
    other, other_table = (fps, table) if other is None else (other, other_table)
    for of, at in zip(table, other_table):
        keep = np.abs(of[i] - at[j]) <= max_bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ other[j]) <= max_bits
    return i[keep], j[keep]


def group_links(group: np.ndarray, nodes: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forests of the links inside each run of equal group numbers (runs of at most TILE)."""
    table, n, d, out = coordinates(fps), len(fps), 1, []
    forests: dict[int, _Forest] = {}
    i = np.arange(n - 1)
    while len(i := i[(i + d < n) & (group[np.minimum(i + d, n - 1)] == group[i])]):
        a, b = survivors(fps, table, i, i + d, max_bits)
        for x, y, g in zip(nodes[a].tolist(), nodes[b].tolist(), group[a].tolist()):
            if forests.setdefault(g, _Forest()).join(x, y):
                out.append((x, y))
        d += 1
    return out


def nearest_forest(nodes: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least spanning forest, by Boruvka's rounds, of the rows' pairs that differ in at most max_bits bits."""
    apart = np.zeros((len(fps), len(fps)), np.int16)
    for at in range(0, len(fps), 256):
        for k in range(fps.shape[1]):
            apart[at : at + 256] += np.bitwise_count(fps[at : at + 256, k, None] ^ fps[None, :, k])
    label = np.unique(nodes, return_inverse=True)[1]
    out, far = [], max_bits + 1
    while True:
        best, other = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
        for at in range(0, len(fps), 256):
            d = np.where(label[at : at + 256, None] == label[None], far, apart[at : at + 256])
            other[at : at + 256] = d.argmin(axis=1)
            best[at : at + 256] = np.take_along_axis(d, other[at : at + 256, None], 1)[:, 0]
        x = np.flatnonzero(best < far)
        if not len(x):
            break
        x = x[np.lexsort((other[x], x, best[x], label[x]))]
        x = x[np.unique(label[x], return_index=True)[1]]
        forest = _Forest()
        for i, j in zip(x.tolist(), other[x].tolist()):
            if forest.join(int(label[i]), int(label[j])):
                out.append((i, j))
        root = np.arange(label.max() + 1)
        for v in forest.up:
            root[v] = forest.find(v)
        label = root[label]
    return np.array([i for i, _ in out], np.int64), np.array([j for _, j in out], np.int64)


class Candidates:
    """Pairs of rows (node, words...) that differ in at most max_bits bits; of groups with more than `crowd` pairs a row a
    least spanning forest, the group being told as crowded. Of tiles of one key only neighbours are compared."""

    neighbours = True

    def __init__(self, max_bits: int, crowd: int):
        self.max_bits, self.crowd = max_bits, crowd

    def _chosen(self, group: np.ndarray, rows: np.ndarray, steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes of the pairs that steps have; then `crowded` has the groups with too many."""
        sizes = np.bincount(group)
        found, held = np.zeros(len(sizes), np.int64), []
        most = self.crowd * sizes
        for i, j in steps:
            found += np.bincount(group[i], minlength=len(sizes))
            few = found[group[i]] <= most[group[i]]
            held.append((i[few].astype(np.int32), j[few].astype(np.int32)))
        self.crowded = np.flatnonzero(found > most)
        if held:
            i, j = (np.concatenate(x) for x in zip(*held))
            few = found[group[i]] <= most[group[i]]
            yield rows[i[few], 0], rows[j[few], 0]
        for g in self.crowded:
            some = rows[group == g]
            i, j = nearest_forest(some[:, 0], np.ascontiguousarray(some[:, 1:]).view(np.uint64), self.max_bits)
            yield some[i, 0], some[j, 0]

    def _near(self, fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = distance(fps[i], fps[j]) <= self.max_bits
        return i[keep], j[keep]

    def within(self, group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs inside each run of equal group numbers 0, 1, ..."""
        fps, n = np.ascontiguousarray(rows[:, 1:]).view(np.uint64), len(rows)

        def steps():
            i, d = np.arange(n - 1), 1
            while len(i := i[(i + d < n) & (group[np.minimum(i + d, n - 1)] == group[i])]):
                yield self._near(fps, i, i + d)
                d += 1

        return self._chosen(group, rows, steps())

    def across(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs between two tiles of rows."""
        rows = np.concatenate((a, b))
        fps = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)

        def steps():
            for at in range(0, len(a), 256):
                i = np.repeat(np.arange(at, min(at + 256, len(a))), len(b))
                yield self._near(fps, i, len(a) + np.tile(np.arange(len(b)), len(i) // len(b)))

        return self._chosen(np.zeros(len(rows), np.int64), rows, steps())


class Forests:
    """Spanning forests of the links of rows (fingerprint), in place of all pairs."""

    crowded = np.zeros(0, np.int64)
    neighbours = False

    def __init__(self, max_bits: int):
        self.max_bits = max_bits

    def within(self, group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found = group_links(group, rows[:, 0], np.ascontiguousarray(rows[:, 0]).view(np.uint64), self.max_bits)
        yield np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64)

    def across(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fa, fb = (np.ascontiguousarray(x[:, 0]).view(np.uint64) for x in (a, b))
        ta, tb, forest, found = coordinates(fa), coordinates(fb), _Forest(), []
        for at in range(0, len(a), 256):
            i = np.repeat(np.arange(at, min(at + 256, len(a))), len(b))
            j = np.tile(np.arange(len(b)), len(i) // len(b))
            i, j = survivors(fa, ta, i, j, self.max_bits, fb, tb)
            found += [(p, q) for p, q in zip(a[i, 0].tolist(), b[j, 0].tolist()) if forest.join(p, q)]
        yield np.array([x for x, _ in found], np.int64), np.array([y for _, y in found], np.int64)


_LINKS = pa.schema([("choice", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("tile", pa.list_(pa.int64()))])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none(_LINKS.field("tile").type)], schema=_LINKS)


def _scan(pairs: Forests | Candidates, tile: int):
    """Runs over rows sorted by (choice, key, node): pairs within a tile, the tiles of keys that may go on elsewhere, and
    (neither pair nor tile) the keys with too many pairs."""

    def emit(rows: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """rows: whole keys, but for the task's first and last ones."""
        key = rows[:, :2]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(rows)))
        group = np.repeat(np.arange(len(starts)), sizes)
        pos = np.arange(len(rows)) - np.repeat(starts, sizes)
        at_piece, piece = np.unique(group * (len(rows) // tile + 2) + pos // tile, return_index=True, return_inverse=True)[1:]
        for a, b in pairs.within(piece, rows[:, 2:]):
            if len(a):
                yield _pairs(a, b)
        out = [{"choice": int(rows[at, 0]), "key": int(rows[at, 1])} for at in at_piece[pairs.crowded]]
        open_groups = ({0} if first else set()) | ({len(starts) - 1} if last else set()) | set(np.flatnonzero(sizes > tile).tolist())
        for g in sorted(open_groups):
            for at in range(starts[g], starts[g] + sizes[g], tile):
                to = min(at + tile, starts[g] + sizes[g])
                out.append({"choice": int(rows[at, 0]), "key": int(rows[at, 1]), "tile": rows[at:to, 2:].reshape(-1).tolist()})
        if out:
            yield pa.RecordBatch.from_pylist(out, _LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, first = 0, True
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            n += b.num_rows
            if n < HELD:
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1 if (rows[0, :2] != rows[-1, :2]).any() else 0
            if not cut:
                if n < 8 * HELD:
                    held = [rows]
                    continue
                cut = n - n % tile  # one key only: whole tiles of it
                yield from emit(rows[:cut], True, True)
                first = True
            else:
                yield from emit(rows[:cut], first, False)
                first = False
            held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield from emit(np.concatenate(held), first, True)

    return run


def _cross(pairs: Forests | Candidates, columns: int):
    """Pairs between two tiles of one key, as _scan has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for choice, key, x, y in zip(*(c for c in batch.columns)):
                for a, b in pairs.across(*(np.array(v.as_py(), np.int64).reshape(-1, columns) for v in (x, y))):
                    if len(a):
                        yield _pairs(a, b)
                if len(pairs.crowded):
                    yield pa.RecordBatch.from_pylist([{"choice": choice.as_py(), "key": key.as_py()}], _LINKS)

    return run


def _linked(keyed: DataFrame, columns: list[str], pairs: Forests | Candidates, tile: int) -> DataFrame:
    """(choice, key, a, b) over keyed(choice, key, node, columns...): pairs of every key, and (without a pair) the keys that
    have too many. Of keys of several tiles pairs of tile numbers are dealt out first; the tiles are joined to them, so
    one key's pairs spread over tasks."""
    rows = keyed.select("choice", "key", "node", *columns)
    ordered = rows.repartitionByRange("choice", "key", "node").sortWithinPartitions("choice", "key", "node")
    found = written(ordered.mapInArrow(released(_scan(pairs, tile)), "choice int, key long, a long, b long, tile array<long>"), "simhash-links")
    tiles = found.where("tile is not null").select("choice", "key", "tile", F.col("tile")[0].alias("low"))
    of_key = Window.partitionBy("choice", "key")
    meta = tiles.select("choice", "key", "low", F.row_number().over(of_key.orderBy("low")).alias("k"), F.count(F.lit(1)).over(of_key).alias("n")).where("n > 1")
    meta = written(meta, "simhash-tiles")
    if not meta.count():
        return found.where("tile is null").drop("tile")
    last = F.least(F.col("k") + 1, F.col("n")) if pairs.neighbours else F.col("n")
    numbers = meta.where("k < n").select("choice", "key", "low", F.explode(F.sequence(F.col("k") + 1, last.cast("int"))).alias("k"))
    numbers = numbers.join(meta.select("choice", "key", "k", F.col("low").alias("low2")), ["choice", "key", "k"]).drop("k")
    both = numbers.join(tiles, ["choice", "key", "low"]).join(tiles.select("choice", "key", F.col("low").alias("low2"), F.col("tile").alias("tile2")), ["choice", "key", "low2"])
    spread = both.select("choice", "key", "tile", "tile2").repartition(F.xxhash64("choice", "key", "low", "low2"))
    more = spread.mapInArrow(released(_cross(pairs, 1 + len(columns))), "choice int, key long, a long, b long, tile array<long>")
    all_ = found.where("tile is null").union(more).drop("tile")
    if pairs.neighbours:  # the rest of such keys is left to the cells
        nothing = F.lit(None).cast("long")
        all_ = all_.union(meta.select("choice", "key", nothing, nothing).distinct())
    return all_


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b) over distinct(fp): enough links of at most max_bits differing bits to connect all that are connected."""
    keyed = distinct.select(F.col("fp").alias("node"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(max_bits, blocks)])).alias("choice", "key"))
    return _linked(keyed, [], Forests(max_bits), tile).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed), fingerprint (16 hex digits), component_id.

    component_id is the least doc_id of all documents that links reach, the document itself included. Null and wordless
    texts have fingerprint 0 and are linked like any other. Copies meet as one fingerprint before any linking. A null
    doc_id is never a component's id unless all of its documents have none.
    """
    docs = written(fingerprints(docs, text, doc_id, shingle), "simhash")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    joined = connected_components(links(distinct, max_bits, blocks, tile))
    members = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    members = written(members, "simhash-members")
    lows = members.groupBy("root").agg(F.min("low").alias("component_id"))
    of = members.select("fp", "root").join(lows, "root").select(F.col("fp").alias("own"), "component_id")
    out = docs.join(of, docs.fp == of.own).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those distinct pairs whose sets of shingles have a Jaccard similarity of LEAST or more."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    common, (p, q) = F.size(F.array_intersect("x", "y")), LEAST
    return written(both.where(common * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b"), "simhash-alike")


def cell_links(left: tuple, right: tuple) -> list[tuple[int, int]]:
    """Links between the rows of two sides, each (nodes, components, sets): pairs of different components whose sets have a
    Jaccard similarity of LEAST or more, as a spanning forest of the components."""
    flat = [np.concatenate(side[2]) if len(side[2]) else np.zeros(0, np.int64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side[2])), [len(x) for x in side[2]]) for side in (left, right)]
    shared = np.intersect1d(flat[0], flat[1])
    common = np.zeros((len(left[0]), len(right[0])), np.float32)
    places = []
    for f, r in zip(flat, rows):
        at = np.searchsorted(shared, f)
        at[at == len(shared)] = 0
        keep = shared[at] == f if len(shared) else np.zeros(len(f), bool)
        o = np.argsort(at[keep], kind="stable")
        places.append((at[keep][o], r[keep][o]))
    for begin in range(0, len(shared), CELL_COLUMNS):
        parts = []
        for (at, r), n in zip(places, common.shape):
            i, j = np.searchsorted(at, (begin, begin + CELL_COLUMNS))
            m = np.zeros((n, CELL_COLUMNS), np.float32)
            m[r[i:j], at[i:j] - begin] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    p, q = LEAST
    sizes = [np.array([len(x) for x in side[2]], np.float64) for side in (left, right)]
    close = (common * (p + q) >= (sizes[0][:, None] + sizes[1][None, :]) * p) & (common > 0)
    close &= left[1][:, None] != right[1][None, :]
    forest, out = _Forest(), []
    for i, j in zip(*(x.tolist() for x in np.nonzero(close))):
        if forest.join(int(left[1][i]), int(right[1][j])):
            out.append((int(left[0][i]), int(right[0][j])))
    return out


def _rest(keyed: DataFrame, crowded: DataFrame, joined: DataFrame, sets: DataFrame, cell: int) -> DataFrame:
    """(a, b): links between different components inside crowded keys, all pairs of which are looked at.

    Keys that share nodes are one group. Of a group all rows outside its largest component are one side and all its rows
    the other; both are cut into tiles by a digest of the node, and each pair of tiles is a cell, which one task holds.
    """
    k = keyed.join(crowded, ["choice", "key"], "left_semi").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    k = written(k, "simhash-crowds")
    hubs = k.groupBy("choice", "key").agg(F.min("node").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    members = written(k.join(hubs.select("choice", "key", "hub"), ["choice", "key"]).select("node", "component", "hub").distinct(), "simhash-members")
    groups = connected_components(members, "node", "hub").withColumnsRenamed({"component": "g", "node": "own"})
    nodes = members.select("node", "component").distinct().join(groups, F.col("node") == F.col("own")).drop("own")
    nodes = written(nodes.join(sets.select("node", F.size("shingles").alias("size")), "node"), "simhash-crowd-nodes")
    weight = F.col("size") + CELL_ROW
    parts = nodes.groupBy("g", "component").agg(F.sum(weight.cast("long")).alias("w"))
    of = parts.groupBy("g").agg(F.max(F.struct("w", "component")).alias("big"), F.sum("w").alias("w"))
    tiles = lambda w: F.ceil(w / cell).cast("int")
    of = of.select("g", F.col("big.component").alias("big"), tiles(F.col("w") - F.col("big.w")).alias("few"), tiles(F.col("w")).alias("all"))
    rows = nodes.join(of, "g").join(sets.select("node", "shingles"), "node")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("component <> big").select("g", at("few").alias("i"), upto("all").alias("j"), F.lit(0).alias("side"), "node", "component", "shingles")
    right = rows.where("few > 0").select("g", upto("few").alias("i"), at("all").alias("j"), F.lit(1).alias("side"), "node", "component", "shingles")

    def run(t: pa.Table) -> pa.Table:
        sides = []
        for k in (0, 1):
            own = t.filter(pa.compute.equal(t.column("side"), k))
            sides.append((own.column("node").to_numpy(), own.column("component").to_numpy(), [x.values.to_numpy(zero_copy_only=False) for x in own.column("shingles")]))
        found = cell_links(*sides)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return left.unionByName(right).groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def _loose(docs: DataFrame, row: str, text: str, doc_id: str, tile: int, crowd: int, cell: int) -> DataFrame:
    """(row, doc_id, root) of rows that `row` tells apart: equal roots for groups of near-duplicates."""
    names = ["fp", *(f"fp{k}" for k in range(1, WIDE))]
    all_ = written(shingled(docs, row, text, doc_id), "simhash-rows")
    distinct = written(all_.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    told = distinct.agg(F.count_if(F.col("n") > 1), F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).first()
    several = distinct.where("n > 1").select("node", "first")
    spare = all_.select("node", "row").join(F.broadcast(several) if told[0] <= MAX_BROADCAST_IDS else several, "node").where("row <> first").select("row")
    once = all_.join(F.broadcast(spare) if told[1] <= MAX_BROADCAST_IDS else spare, "row", "left_anti")
    keyed = once.select("node", *names, F.posexplode("keys").alias("choice", "key"))
    found = written(_linked(keyed, names, Candidates(LOOSE_BITS, crowd), tile), "simhash-candidates")
    pairs = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "simhash-pairs")
    crowded = written(found.where("a is null").select("choice", "key").distinct(), "simhash-crowded")
    many = crowded.count()
    few = F.broadcast(crowded) if many <= MAX_BROADCAST_IDS else crowded
    keyed = keyed.select("choice", "key", "node")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if many:
        wanted = wanted.union(keyed.join(few, ["choice", "key"], "left_semi").select("node"))
    wanted = written(wanted.distinct().join(distinct, "node").select(F.col("first").alias("row_")), "simhash-wanted")
    # sets are made again for the texts that have a candidate: writing those of all texts would take more than the texts
    some = docs.select(F.col(row).alias("row_"), F.col(text).cast("binary").alias("t"))
    sets = some.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted, "row_", "left_semi")
    sets = written(shingle_sets(sets), "simhash-sets")
    edges = _alike(pairs, sets)
    if many:
        joined = written(connected_components(edges), "simhash-joined")
        edges = edges.union(written(_rest(keyed, few, joined, sets, cell), "simhash-rest"))
    forget(sets, found)
    prints = written(all_.groupBy("exact", "node").agg(F.count(F.lit(1)).alias("n")), "simhash-prints")
    low = written(prints.groupBy("exact").agg(F.min("node").alias("low_node")), "simhash-low")
    ends = low.select(F.col("exact").alias("end"), "low_node")
    close = links(low.select(F.col("exact").alias("fp")))
    close = close.join(ends.withColumnsRenamed({"end": "a", "low_node": "x"}), "a").join(ends.withColumnsRenamed({"end": "b", "low_node": "y"}), "b").select("x", "y")
    same = prints.join(low, "exact").where("node <> low_node").select("node", "low_node")
    joined = connected_components(edges.union(close).union(same)).withColumnRenamed("node", "own")
    out = all_.select("row", "doc_id", "node").join(joined, F.col("node") == F.col("own"), "left")
    return out.select("row", "doc_id", F.coalesce("component", "node").alias("root"))


def loose_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tile: int = TILE, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """(doc_id, component_id) of every row of docs: copies by the exact 64-bit links or with sets of five-word shingles whose
    Jaccard similarity is 0.8 or more, and what these reach. The latter are verified; see BANDS for those missed.

    component_id is the least id of the component; a null id is one only where all its rows have none. Null and wordless
    texts are copies of each other. Ids may be of any orderable type and may repeat; an empty table gives none.
    """
    docs, row = identified(docs.select(doc_id, text), doc_id, "simhash-docs")
    rows = written(_loose(docs, row, text, doc_id, tile, crowd, cell), "simhash-roots")
    lows = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(lows, "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", loose: bool = True, **how) -> DataFrame:
    """One row of docs for each group of near-duplicates, columns as they were: that with the least doc_id, a null id last.

    loose: near-duplicates as loose_groups has them, else as near_duplicates. Rows are told apart whatever their ids are:
    rows that repeat an id or have none stay unless their texts are near-duplicates, and of rows that agree in id and text
    one stays. Ids may be of any orderable type. An empty table gives an empty one.
    """
    docs, row = identified(docs, doc_id, "simhash-docs")
    if loose:
        how = {"tile": TILE, "crowd": CROWD, "cell": CELL} | how
        found = _loose(docs, row, text, doc_id, **how)
    else:
        groups = near_duplicates(docs, text, row, **how).select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
        found = groups.join(docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id")), "row")
    found = written(found, "simhash-groups")
    several = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = written(several, "simhash-several")
    several = F.broadcast(several) if several.count() <= MAX_BROADCAST_IDS else several
    gone = written(found.join(several, "root").where("row <> stays").select("row"), "simhash-gone")
    (own,) = fresh(docs, "gone")
    gone, n = gone.withColumnRenamed("row", own), gone.count()
    kept = docs.join(F.broadcast(gone) if n <= MAX_BROADCAST_IDS else gone, F.col(row) == F.col(own), "left_anti")
    return kept.drop(row)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
