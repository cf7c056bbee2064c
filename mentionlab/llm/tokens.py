"""Operator 6: token ids in an adaptive context-mixing range-coded format.

Documents are range-partitioned by doc_id and sorted; each task tokenises its documents, appends the end id to each and
gathers whole documents in segments. A segment holds a table of its documents, one of its phrases (the ids of each piece
of text that occurs in it, frequent ones first), and the numbers of the phrases in their order, in independently reset
blocks, each with the CRC-32 of the ids that it stands for. Segments are rows of a Parquet table in ascending doc_id
order: Spark's committer writes them whole or not at all, on any store, and any task can decode any segment by itself.

A text is divided where white space follows another character. There the tokenizer's own rule always divides, whatever
stands before or after, so a piece's ids are the same in any text, and a piece is tokenised once. With a tokenizer that
might not divide there, a text is one piece.

Segment payload: b"MLTC", version, number of documents, blocks, bytes of the document table, phrases, bytes of the phrase
table (little-endian 32-bit), the document table (zlib: doc ids as 64-bit, lengths in ids as 32-bit, a byte that says
whether the id is present), the phrase table (zlib: lengths as 32-bit, low 16 bits of all ids, high 8 bits of them), for
each block its phrases, bytes and CRC-32 (32-bit each), then the coded blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm import rangecoder
from mentionlab.llm.common import released, table, text_of, written

END_ID = 0
#: Ids from which a segment is closed (whole documents), and blocks that are coded side by side.
SEGMENT_IDS, SIDE_BY_SIDE = 1 << 19, 1536
#: Bytes of pieces tokenised at once: a tokenizer's results take about twenty times the text.
TOKENISE_BYTES = 250_000
#: Pieces that a Python worker remembers, and their bytes; beyond either it keeps those that more batches had, half at most.
KNOWN_PIECES, KNOWN_BYTES = 600_000, 16_000_000
_MAGIC, _HEAD = b"MLTC", struct.Struct("<4sIIIIII")
#: Between a character that is no white space by any rule and white space.
_WHITE = " \t\n\x0b\x0c\r"
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\x0b\x0c\r])")
#: The same, and between a letter and punctuation, which the rule divides as well.
_MARKS = ".,;:!?"
_PART = re.compile(rf"(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])(?=[{_MARKS}])|{_BOUNDARY.pattern}")
#: Pieces between spaces after which a text may not be divided: empty ones, and those that end with white space by any rule.
_OPEN = r"^$|[\s\x0b\x1c-\x1f\x{85}\pZ]$"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc(ids: np.ndarray, start: int = 0) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), start)


def divisible(tok) -> bool:
    """Whether tok divides any text wherever white space follows another character: the byte-level rule, nothing before it,
    and no added token that looks beyond itself or holds white space."""
    rule = json.loads(tok.to_str())
    plain = not any(rule[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
    level = rule["pre_tokenizer"] or {}
    level = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level["add_prefix_space"]
    added = (t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in rule["added_tokens"])
    return plain and level and not any(added)


def spell(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of the phrases `which`, one after another; all phrases lie in ids, of these sizes."""
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Pieces:
    """Pieces of texts by number, with their ids. Number 0 is the end id."""

    def __init__(self, tok, end_id: int):
        self.tok, self.end_id, self.divides = tok, end_id, divisible(tok)
        self.known: dict[str, int] = {}
        self.held, self.n, self.uses = 0, 1, np.zeros(KNOWN_PIECES + 1, np.int32)
        named = tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(named.values(), default=0) + 1, np.int64)
        self.bytes[list(named.values())] = [len(s) for s in named]  # a character of a byte-level token is a byte
        for number, t in tok.get_added_tokens_decoder().items():
            self.bytes[number] = len(t.content.encode())
        self._ids, self._sizes = [np.array([end_id], np.uint32)], [np.ones(1, np.int64)]

    def full(self) -> bool:
        return self.n > KNOWN_PIECES or self.held > KNOWN_BYTES

    def renewed(self) -> Pieces:
        """A new beginning with the pieces that more than one batch had, of those the ones that most had; they are at most
        half of what may be remembered."""
        out = Pieces(self.tok, self.end_id)
        size = np.fromiter(map(len, map(str.encode, self.known)), np.int64, len(self.known))
        uses = self.uses[1 : self.n]
        by_use = np.lexsort((np.arange(len(uses)), -uses))
        fits = (np.arange(1, len(uses) + 1) <= KNOWN_PIECES // 2) & (np.cumsum(size[by_use]) <= KNOWN_BYTES // 2) & (uses[by_use] > 1)
        keep = np.zeros(len(uses), bool)
        keep[by_use[fits]] = True
        ids, sizes = self.ids()
        which = 1 + np.flatnonzero(keep)
        out._ids.append(spell(ids, sizes, which))
        out._sizes.append(sizes[which])
        out.known = dict(zip(compress(self.known, keep.tolist()), range(1, len(which) + 1)))
        out.n, out.held = len(which) + 1, int(size[keep].sum())
        return out

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and the pieces' sizes."""
        if len(self._ids) > 1:
            self._ids, self._sizes = [np.concatenate(self._ids)], [np.concatenate(self._sizes)]
        return self._ids[0], self._sizes[0]

    def numbers(self, pieces: list[str], joined: bool) -> np.ndarray:
        """The pieces' numbers. joined: each begins with white space and ends without, so that they divide if put together."""
        known = self.known
        found = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            new = list(dict.fromkeys([pieces[k] for k in missed]))
            if joined:
                self._learn_parts([s for s in new if s[-1] in _MARKS or "\n" in s])
                new = [s for s in new if s not in known]
            self._learn(new, joined)
            found[missed] = [known[pieces[k]] for k in missed]
            if self.n > len(self.uses):
                self.uses = np.concatenate((self.uses, np.zeros(self.n, np.int32)))
        self.uses[found] += 1
        return found

    def _name(self, new: list[str], n_bytes: int) -> None:
        self.known.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)
        self.held += n_bytes

    def _learn(self, new: list[str], joined: bool) -> None:
        sizes = np.fromiter(map(len, map(str.encode, new)), np.int64, len(new))
        edges = [*np.unique(np.cumsum(sizes) // TOKENISE_BYTES, return_index=True)[1].tolist(), len(new)]
        for i, j in zip(edges[:-1], edges[1:]):
            if not (joined and self._together(new[i:j], sizes[i:j])):
                for e in self.tok.encode_batch_fast(new[i:j], add_special_tokens=False):
                    self._ids.append(np.array(e.ids, np.uint32))
                    self._sizes.append(np.array([len(e)]))
        self._name(new, int(sizes.sum()))

    def _learn_parts(self, whole: list[str]) -> None:
        """Learns pieces by their parts, as a word comes with all kinds of punctuation."""
        split = [_PART.split(s) for s in whole]
        some = list(dict.fromkeys(p for parts in split for p in parts if p not in self.known))
        self._learn([s for s in some if s[0] in _WHITE], True)
        self._learn([s for s in some if s[0] not in _WHITE], False)
        several = [k for k, s in enumerate(whole) if s not in self.known]
        if several:
            count = np.array([len(split[k]) for k in several])
            which = np.array([self.known[p] for k in several for p in split[k]])
            ids, sizes = self.ids()
            self._ids.append(spell(ids, sizes, which))
            self._sizes.append(np.add.reduceat(sizes[which], np.cumsum(count) - count))
            self._name([whole[k] for k in several], sum(len(whole[k].encode()) for k in several))

    def _together(self, pieces: list[str], sizes: np.ndarray) -> bool:
        """Tokenises pieces as one text; the bytes that its ids stand for tell where a piece ends. False where they don't."""
        (e,) = self.tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        reached, ends = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
        last = np.searchsorted(reached, ends)
        if last[-1] != len(ids) - 1 or (reached[last] != ends).any():
            return False
        self._ids.append(ids)
        self._sizes.append(np.diff(last, prepend=-1))
        return True

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The numbers of each text's pieces, and of the end id."""
        if not self.divides:
            for s in texts.to_pylist():
                yield np.append(self.numbers([s], False), 0)
            return
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes, strings = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        opened = np.concatenate(([0], np.cumsum(pc.match_substring_regex(strings, _OPEN).to_numpy(zero_copy_only=False)[codes])))
        odd = opened[at[1:]] > opened[at[:-1]]
        later = np.repeat(~odd, np.diff(at))
        later[at[:-1]] = False  # a text's first piece follows no space
        used = np.flatnonzero(np.bincount(codes[later], minlength=len(strings)))
        number = np.zeros(len(strings), np.int64)
        number[used] = self.numbers(pc.binary_join_element_wise(pa.scalar("", strings.type), strings.take(pa.array(used)), pa.scalar(" ", strings.type)).to_numpy(zero_copy_only=False).tolist(), True)
        of_first = strings.take(pa.array(codes[at[:-1]])).to_pylist()
        number = number[codes]
        number[at[:-1][~odd]] = self.numbers([s for s, o in zip(of_first, odd.tolist()) if not o], False)
        for k, o in enumerate(odd.tolist()):
            if o:
                some = [s for s in _BOUNDARY.split(texts[k].as_py()) if s]
                yield np.concatenate((self.numbers(some[:1], False), self.numbers(some[1:-1], True), self.numbers(some[1:][-1:], False), [0]))
            else:
                yield np.append(number[at[k] : at[k + 1]], 0)


#: The pieces that this Python worker remembers from task to task, of one tokenizer and end id.
_held: dict[tuple[str, int], Pieces] = {}


def pieces_of(path: str, end_id: int) -> Pieces:
    """What the worker remembers, with a new beginning where that is full."""
    there = _held.get((path, end_id))
    if there is None:
        from tokenizers import Tokenizer

        _held.clear()
        there = _held[path, end_id] = Pieces(Tokenizer.from_file(path), end_id)
    elif there.full():
        there = _held[path, end_id] = there.renewed()
    return there


class Segment:
    """Documents that are written together, as numbers of the same pieces."""

    def __init__(self, part_start: int, pieces: Pieces):
        self.part_start, self.pieces, self.codes, self.docs = part_start, pieces, [], []
        self.n = self.n_codes = 0

    def add(self, doc_id: int | None, codes: np.ndarray, n: int) -> None:
        self.docs.append((doc_id, n))
        self.codes.append(codes)
        self.n += n
        self.n_codes += len(codes)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the phrases, their sizes, and the segment as numbers of them: frequent ones first, then those that come
        first. Phrases are pieces, or single ids where there are more pieces than the coder has numbers."""
        ids, sizes = self.pieces.ids()
        codes = np.concatenate(self.codes)
        self.codes, self.pieces = [], None
        count = np.bincount(codes)
        if np.count_nonzero(count) > 1 << rangecoder.ID_BITS:
            codes = spell(ids, sizes, codes).astype(np.int64)
            count = np.bincount(codes)
            ids, sizes = np.arange(len(count), dtype=np.uint32), np.ones(len(count), np.int64)
        first = np.zeros(len(count), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        own = np.flatnonzero(count)
        own = own[np.lexsort((first[own], -count[own]))]
        rank = np.zeros(len(count), np.int32)
        rank[own] = np.arange(len(own))
        return spell(ids, sizes, own), sizes[own], rank[codes]


def _edges(n: int) -> list[int]:
    return [*range(0, n, rangecoder.BLOCK), n]


def _crcs(ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, edges: list[int]) -> list[int]:
    """The CRC-32 of the ids of each block."""
    at = np.concatenate(([0], np.cumsum(sizes[ranks])))[edges].tolist()
    raw = memoryview(np.ascontiguousarray(spell(ids, sizes, ranks), "<u4").tobytes())
    return [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])]


def encode_segments(segments: list[Segment]) -> list[bytes]:
    """Payloads; the blocks of all segments are coded side by side. The segments give their codes up."""
    found = [s.phrases() for s in segments]
    edges = [_edges(len(ranks)) for _, _, ranks in found]
    coded = iter(rangecoder.encode([r[i:j] for (_, _, r), e in zip(found, edges) for i, j in zip(e[:-1], e[1:])]))
    out = []
    for s, (ids, sizes, ranks), e in zip(segments, found, edges):
        own = [next(coded) for _ in e[1:]]
        keys = np.array([d or 0 for d, _ in s.docs], "<i8").tobytes()
        docs = zlib.compress(keys + np.array([n for _, n in s.docs], "<u4").tobytes() + bytes(d is not None for d, _ in s.docs), 6)
        phrases = zlib.compress(sizes.astype("<u4").tobytes() + (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("u1").tobytes(), 1)
        heads = np.array(list(zip(np.diff(e).tolist(), map(len, own), _crcs(ids, sizes, ranks, e))), "<u4").tobytes()
        out.append(b"".join([_HEAD.pack(_MAGIC, 2, len(s.docs), len(own), len(docs), len(sizes), len(phrases)), docs, phrases, heads, *own]))
    return out


def parse(payload: bytes) -> tuple[list[int | None], np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, list[bytes]]:
    """Doc ids, document lengths, (ids, sizes) of phrases, (phrases, bytes, CRC) of blocks, coded blocks."""
    magic, version, n_docs, n_blocks, size, n_phrases, more = _HEAD.unpack_from(payload)
    if magic != _MAGIC or version != 2:
        raise ValueError("not a token segment")
    at = _HEAD.size
    try:
        docs, phrases = zlib.decompress(payload[at : at + size]), zlib.decompress(payload[at + size : at + size + more])
    except zlib.error as e:
        raise ValueError("a table of a token segment is damaged") from e
    keys, lengths, there = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs), docs[12 * n_docs :]
    sizes = np.frombuffer(phrases, "<u4", n_phrases).astype(np.int64)
    n = int(sizes.sum())
    ids = np.frombuffer(phrases, "<u2", n, 4 * n_phrases) | np.frombuffer(phrases, "u1", n, 4 * n_phrases + 2 * n).astype(np.uint32) << 16
    at += size + more
    heads = np.frombuffer(payload, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += heads.nbytes
    coded = []
    for _, size, _ in heads.tolist():
        coded.append(payload[at : at + size])
        at += size
    return [k if t else None for k, t in zip(keys.tolist(), there)], lengths.astype(np.int64), (ids, sizes), heads.astype(np.int64), coded


def decode_segments(payloads: list[bytes]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, document lengths, all ids) of each segment; a block whose CRC differs raises ValueError."""
    parsed = [parse(p) for p in payloads]
    blocks = iter(rangecoder.decode([c for p in parsed for c in p[4]], [int(n) for p in parsed for n in p[3][:, 0]]))
    for keys, lengths, (ids, sizes), heads, _ in parsed:
        ranks = np.concatenate([next(blocks) for _ in heads] or [np.zeros(0, np.int32)])
        if len(ranks) and int(ranks.max()) >= len(sizes) or _crcs(ids, sizes, ranks, _edges(len(ranks))) != heads[:, 2].tolist():
            raise ValueError("a block's checksum differs")
        yield keys, lengths, spell(ids, sizes, ranks)


def _sides(items, count):
    """Runs of items whose block counts add up to about SIDE_BY_SIDE."""
    held, n = [], 0
    for x in items:
        held.append(x)
        n += count(x)
        if n >= SIDE_BY_SIDE:
            yield held
            held, n = [], 0
    if held:
        yield held


def write_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID, name: str = "tokens") -> DataFrame:
    """Writes docs in the file format and returns the written table: part, seg, first_id, part_start, n_ids, payload.

    Ascending doc_id, nulls first; rows that repeat a doc_id follow in order of text. A null text is empty: the end id
    alone. An empty table gives no segment. doc_id must be an integer column. Ranges are of id and the beginning of the
    text, so rows that repeat an id, or have none, spread over tasks; other columns of docs are not looked at.
    """
    where = path or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    laid = rows.withColumn("head", F.substring("text", 1, 32)).repartitionByRange("doc_id", "head")
    ordered = laid.drop("head").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()

        def segments() -> Iterator[Segment]:
            seg = None
            start = 0
            for b in batches:
                pieces = pieces_of(where, end_id)
                if seg and seg.pieces is not pieces:  # a segment is of the same pieces
                    yield seg
                    seg = None
                for k, codes in zip(b.column(0).to_pylist(), pieces.of(b.column(1))):
                    seg = seg or Segment(start, pieces)
                    n = int(pieces.ids()[1][codes].sum())
                    seg.add(k, codes, n)
                    start += n
                    if seg.n >= SEGMENT_IDS:
                        yield seg
                        seg = None
            if seg:
                yield seg

        number = 0
        for some in _sides(segments(), lambda s: -(-s.n_codes // rangecoder.BLOCK)):
            for s, p in zip(some, encode_segments(some)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([s.docs[0][0]], pa.int64()), pa.array([s.part_start], pa.int64()), pa.array([s.n], pa.int64()), pa.array([p], pa.binary())],
                    names=["part", "seg", "first_id", "part_start", "n_ids", "payload"],
                )
                number += 1

    return written(ordered.mapInArrow(released(run), "part int, seg int, first_id long, part_start long, n_ids long, payload binary"), name)


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """What write_tokens has written: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and ids on demand.

    Ids before a part are a running sum over one row for each part, in the order of their first documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, s, x) for b in batches for p, s, x in zip(*(c.to_pylist() for c in b.columns)))
        for some in _sides(rows, lambda r: struct.unpack_from("<I", r[2], 12)[0]):
            for (part, start, _), (keys, lengths, ids) in zip(some, decode_segments([r[2] for r in some])):
                at = np.concatenate(([0], np.cumsum(lengths)))
                raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(start + at[:-1]), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    found = files.select("part", "part_start", "payload").mapInArrow(released(run), "doc_id long, part int, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    parts = files.groupBy("part").agg(F.min(F.struct(F.col("first_id").isNotNull(), "first_id")).alias("first"), F.sum("n_ids").alias("n"))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
