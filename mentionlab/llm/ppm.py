"""Operator 2: language-model scores by prediction by partial matching (PPM) over bytes.

Learning: one pass counts words and (ORDER + 1)-byte strings of the training documents; both are summed by Spark. The
counts of shorter contexts follow from the longest ones, since every position has a full one (documents begin with
ORDER boundary bytes 0xFF, which no UTF-8 text holds, and end with one). The trie is these tables, one for each order:
every string that was seen is in them, however many there are, and they grow with the corpus.

Coding: method C escapes with symbol exclusion. A symbol that its longest known context lacks is coded in the next
shorter one without the symbols already excluded. As a context's symbols all occur in its suffix, what is excluded
depends on the context alone; so the code length of a symbol after ORDER bytes depends on these bytes and it alone, and
a document's score is the sum over its strings of ORDER + 1 bytes. The code lengths of distinct strings are computed by
joins of the tables, order by order: strings that training has seen end at the first, others go down and get fewer.

The most frequent strings, SENT at most, are sent to the executors with their code lengths; a document's other strings
are counted in it and joined with theirs. What is sent decides how much is shuffled and never a result.

Base score: add-one word unigrams. The most frequent words, HEAVY at most, are sent to the executors; all other words of
a document are joined with their counts by a shuffle without hot keys.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import forget, released, table, written

ORDER, SENT, HEAVY = 5, 500_000, 80_000
#: Bytes of text that a worker counts or scores at once, words and strings it holds before it hands counts on.
CHUNK, HELD_WORDS, HELD_GRAMS = 1 << 19, 120_000, 800_000
EDGE = 0xFF
_U = np.uint64


def lowered(text: bytes | None) -> bytes:
    return (text or b"").lower()  # for bytes: A-Z only


class Trie:
    """PPM over one growing byte history, plainly: for adaptive code lengths."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.next: dict[bytes, Counter] = defaultdict(Counter)

    def learn(self, text: bytes) -> None:
        line = bytes([EDGE]) * self.order + text + bytes([EDGE])
        for i in range(self.order, len(line)):
            self.count(line[i - self.order : i], line[i])

    def count(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.next[context[self.order - k :]][symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        excluded: set[int] = set()
        total = 0.0
        for k in range(self.order, -1, -1):
            seen = self.next.get(context[self.order - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return total + math.log10(left[symbol] / whole)
            total += math.log10(len(left) / whole)
            excluded |= left.keys()
        return total - math.log10(256 - len(excluded))

    def score(self, text: bytes, adaptive: bool = False) -> float:
        """log10 probability of a text; adaptive: each symbol is learned once it is coded."""
        line, total = bytes([EDGE]) * self.order + text + bytes([EDGE]), 0.0
        for i in range(self.order, len(line)):
            context = line[i - self.order : i]
            total += self.log10(context, line[i])
            if adaptive:
                self.count(context, line[i])
        return total


class _Index:
    """Open-addressing table of distinct keys below 2**63; find gives positions in the given array, -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        got = self.slot[at]
        wrong = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            got[wrong] = self.slot[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[got[wrong]] != keys[wrong])]
        return got


class Known:
    """Code lengths (log10 probabilities) of strings by look-up; the others of a text are counted."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, order: int = ORDER):
        self.order, self.index, self.logs = order, _Index(grams.astype(np.int64)), logs

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, its end included: the sum over its known strings; and (text number, string, times) of the others."""
        codes, starts = gram_codes(texts, self.order)
        codes = codes.astype(np.int64)
        at = self.index.find(codes)
        there = at >= 0
        values = np.zeros(len(codes))
        values[there] = self.logs[at[there]]
        more = np.flatnonzero(~there)
        of, code = np.searchsorted(starts, more, "right") - 1, codes[more]
        o = np.lexsort((code, of))
        of, code = of[o], code[o]
        first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])))) if len(of) else np.zeros(0, np.int64)
        return np.add.reduceat(values, starts), of[first], code[first], np.diff(np.append(first, len(of)))


def gram_codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code of (context, symbol) at each byte and at the end of each text, and where each text begins in them."""
    edge = bytes([EDGE])
    line = np.frombuffer(edge * order + (edge * order).join([*texts, b""]) if order > 0 else edge.join([*texts, b""]), np.uint8)
    code = np.zeros(len(line), _U)
    for k in range(order + 1):
        code[k:] |= line[: len(line) - k].astype(_U) << _U(8 * k)
    if order == 0:
        return code, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    ends = np.cumsum([len(t) + order for t in texts]) + order  # one past the last boundary byte of each gap
    keep = np.ones(len(line), bool)
    keep[:order] = False
    for j in range(order - 1):
        keep[ends - 1 - j] = False
    return code[keep], np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def count(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(word, gram, n): partial counts of words (gram null), and of (order + 1)-byte strings and ends (word null; the
    number of documents has gram -1), from each task; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts, held, n = [], [], 0, 0

        def tell(w=None, g=None) -> pa.RecordBatch:
            if w is not None:
                return pa.RecordBatch.from_arrays([pa.array(list(w), pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(list(w.values()), pa.int64())], names=["word", "gram", "n"])
            return pa.RecordBatch.from_arrays([pa.nulls(len(g[0]), pa.binary()), pa.array(g[0].astype(np.int64)), pa.array(g[1].astype(np.int64))], names=["word", "gram", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            o = np.argsort(k, kind="stable")
            k, c = k[o], c[o]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            return k[at], np.add.reduceat(c, at)

        for b in batches:
            texts = [lowered(t) for t in b.column(0).to_pylist()]
            n += len(texts)
            for t in texts:
                words.update(t.split())
                if len(words) > HELD_WORDS:
                    yield tell(w=words)
                    words = Counter()
            for _, some in _chunks(texts):
                codes = np.sort(gram_codes(some, order)[0])
                at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                keys.append(codes[at])
                counts.append(np.diff(np.append(at, len(codes))))
                held += len(at)
                if held > HELD_GRAMS:
                    k, c = merged()
                    if len(k) > HELD_GRAMS // 2:
                        yield tell(g=(k, c))
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [c], len(k)
        if words:
            yield tell(w=words)
        if keys:
            yield tell(g=merged())
        yield tell(g=(np.array([-1]), np.array([n])))

    return written(docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(released(run), "word binary, gram long, n long"), "ppm-counts")


def _floor(rows: DataFrame, n: str, most: int) -> int:
    """A power of two that at most `most` of the rows' counts reach; from counts of counts, a few rows."""
    kept = 0
    for r in sorted(rows.groupBy(F.floor(F.log2(n)).alias("log")).count().collect(), key=lambda r: -r["log"]):
        kept += r["count"]
        if kept > most:
            return 1 << (r["log"] + 1)
    return 1


def _mask(symbols: int) -> Column:
    """Bits of the last `symbols` bytes of a string."""
    return F.lit((1 << 8 * symbols) - 1)


class Model:
    """The trie as tables: for each order k the strings of k + 1 bytes, (gram, n), and their contexts."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        top = written(counts.where("gram >= 0").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
        self.grams = [top]
        for k in range(order - 1, -1, -1):  # each from the next longer one
            shorter = self.grams[0].groupBy(F.col("gram").bitwiseAND(_mask(k + 1)).alias("gram")).agg(F.sum("n").alias("n"))
            self.grams.insert(0, written(shorter, f"ppm-order{k}"))
        whole = Window.partitionBy(F.shiftright("gram", 8))  # at most 256 rows
        own = top.withColumn("log", F.log10(F.col("n") / (F.sum("n").over(whole) + F.count(F.lit(1)).over(whole))))
        self.own = written(own, "ppm-own")

    def contexts(self, k: int) -> DataFrame:
        """(ctx, total, kinds, rest, rest_kinds): a context's count and symbols; those of its suffix without its symbols."""
        at = F.shiftright("gram", 8).alias("ctx")
        own = self.grams[k].groupBy(at).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        if not k:
            return own.select("*", F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("rest_kinds"))
        shorter = self.grams[k - 1].withColumnsRenamed({"gram": "low", "n": "low_n"})
        taken = self.grams[k].select("gram", F.col("gram").bitwiseAND(_mask(k)).alias("low")).join(shorter, "low").groupBy(at).agg(F.sum("low_n").alias("taken"))
        above = self.grams[k - 1].groupBy(F.shiftright("gram", 8).alias("suffix")).agg(F.sum("n").alias("whole"), F.count(F.lit(1)).alias("all_kinds"))
        both = own.join(taken, "ctx").withColumn("suffix", F.col("ctx").bitwiseAND(_mask(k - 1))).join(above, "suffix")
        return both.select("ctx", "total", "kinds", (F.col("whole") - F.col("taken")).alias("rest"), (F.col("all_kinds") - F.col("kinds")).alias("rest_kinds"))

    def unseen(self, strings: DataFrame) -> DataFrame:
        """(gram, log) of distinct strings(gram) that training has not seen: down through the orders, each join for those
        that have not ended yet."""
        none = F.lit(None).cast("long")
        left = strings.select("gram", F.lit(0.0).alias("cost"), none.alias("rest"), none.alias("rest_kinds"))
        ended = []
        for k in range(self.order, -1, -1):
            grams = self.grams[k].select(F.col("gram").alias("code"), "n")
            contexts = self.contexts(k).withColumnsRenamed({"rest": "next_rest", "rest_kinds": "next_kinds"})
            at = left.withColumn("code", F.col("gram").bitwiseAND(_mask(k + 1))).withColumn("ctx", F.shiftright("code", 8))
            at = written(at.join(grams, "code", "left").join(contexts, "ctx", "left"), "ppm-unseen")
            inside = F.col("rest").isNotNull()  # a longer context is known: its symbols are excluded
            hit = F.when(inside, F.col("n") / (F.col("rest") + F.col("rest_kinds"))).otherwise(F.col("n") / (F.col("total") + F.col("kinds")))
            ended.append(at.where("n is not null").select("gram", (F.col("cost") + F.log10(hit)).alias("log")))
            out = F.when(inside & (F.col("rest_kinds") > 0), F.col("rest_kinds") / (F.col("rest") + F.col("rest_kinds")))
            out = out.when(~inside & F.col("kinds").isNotNull(), F.col("kinds") / (F.col("total") + F.col("kinds"))).otherwise(1.0)
            left = at.where("n is null").select("gram", (F.col("cost") + F.log10(out)).alias("cost"), F.col("next_rest").alias("rest"), F.col("next_kinds").alias("rest_kinds"))
        symbols = self.grams[0].count()
        ended.append(left.select("gram", (F.col("cost") - math.log10(max(1, 256 - symbols))).alias("log")))
        all_ = ended[0]
        for e in ended[1:]:
            all_ = all_.union(e)
        return all_

    def sent(self, most: int) -> tuple[Known, int]:
        """The most frequent strings, at most `most`, and the least count they have."""
        least = _floor(self.own, "n", most)
        got = self.own.where(F.col("n") >= least).select("gram", "log").toArrow()
        return Known(got.column("gram").to_numpy(), got.column("log").to_numpy(), self.order), least


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, sent: int = SENT, heavy: int = HEAVY) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows that are not held out teach (a null held_out is not). Null text is empty: its end alone is scored. With nothing
    to learn from every base probability is 1 and bytes are uniform. Repeated rows teach and are scored each. `sent` and
    `heavy` bound what executors are sent; results do not depend on them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    counts = count(rows.where(~F.col("held_out")), "t", order)
    vocabulary = written(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "ppm-words")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    taught = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = total.n + taught, total.v + (taught > 0)
    floor = _floor(vocabulary, "c", heavy)
    frequent = {r.word: r.c for r in vocabulary.where(F.col("c") >= floor).collect()}
    model = Model(counts, order)
    forget(counts)
    known, least = model.sent(sent)
    shared = docs.sparkSession.sparkContext.broadcast((known, {bytes(w): math.log10(c + 1) for w, c in frequent.items()}))
    end, end_known = (math.log10(taught + 1), 1) if taught else (0.0, 0)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = [lowered(t) for t in b.column(2).to_pylist()]
            for at, some in _chunks(texts):
                scores, of, code, often = known.scores(some)
                tokens, found, sums, words, times, offsets = [], [], [], [], [], [0]
                for t in some:
                    own = Counter(t.split())
                    k, s = end_known, end
                    for w, c in own.items():
                        x = logs.get(w)
                        if x is None:
                            words.append(w)
                            times.append(c)
                        else:
                            k += c
                            s += c * x
                    tokens.append(own.total() + 1)
                    found.append(k)
                    sums.append(s)
                    offsets.append(len(words))
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], names=["w", "c"]))
                m = len(some)
                ends = np.searchsorted(of, np.arange(m + 1))
                strings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(code, pa.int64()), pa.array(often, pa.int32())], names=["g", "c"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + m)), b.column(0).slice(at, m), b.column(1).slice(at, m), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), rare, strings],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "sum", "score", "rare", "strings"],
                )
                row += m

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sum double, score double, rare array<struct<w: binary, c: int>>, strings array<struct<g: long, c: int>>"
    done = written(rows.mapInArrow(released(run), schema), "ppm-scores")
    rare = done.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.c").alias("times"))
    found = rare.join(vocabulary.where(F.col("c") < floor), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_sum"))
    strings = done.select("row", F.explode("strings").alias("x")).select("row", F.col("x.g").alias("gram"), F.col("x.c").alias("times"))
    seen = model.own.where(F.col("n") < least).select("gram", "log")
    unseen = done.where("held_out").select(F.explode("strings").alias("x")).select(F.col("x.g").alias("gram")).distinct().join(seen, "gram", "left_anti")
    codes = seen.union(model.unseen(written(unseen, "ppm-strings")))
    longer = strings.join(codes, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("rest"))
    all_ = done.drop("rare", "strings").join(found, "row", "left").join(longer, "row", "left")
    base = F.col("sum") + F.coalesce("more_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score")
    )


def adaptive_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """(doc_id, score): log10 probability of each text under a model that starts empty and learns as it goes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Trie(order).score(lowered(t), adaptive=True) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(released(run), f"doc_id {kind}, score double")


def op2_ppm(spark, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score(table(spark, sf_dir, "documents"), held)
