"""Operator 5: language identification with a blended-spectrum string kernel.

Two texts are as similar as the byte n-grams (n = 1..4) that occur in both: k(x, z) = |N(x) & N(z)| / sqrt(|N(x)| |N(z)|),
presence only, however often an n-gram occurs. A bounded sample of labelled documents gives the landmarks and the
training rows; the Nystroem map turns a text into K_mm^(-1/2) k_m(x), and a ridge regression for each language against
the rest works on that. Kernels of training texts are products of their presence rows with the landmarks'; for scoring
landmarks, map and weights are multiplied beforehand, so a batch is one product of its sparse presence rows with a
matrix of n-grams by languages.

Only n-grams of landmarks can be shared with one; a text's other n-grams count for its norm. N-grams are numbers of BITS
bits: of n distinct ones about n / 2 ** (BITS + 1) of them fall on another, 0.6 % of 100,000.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import released, table, written

#: Bounds of the fit: languages (the most frequent ones), documents of each, and landmarks, of which every language
#: gets LEAST_LANDMARKS at least.
LANGUAGES, PER_LANGUAGE, LANDMARKS, LEAST_LANDMARKS = 1000, 500, 96, 8
ORDERS = (1, 2, 3, 4)
BITS = 23
RIDGE = 1e-3
#: Documents and n-gram positions that a worker handles at once.
BATCH_DOCS, BATCH_BYTES = 256, 2 << 20
#: Numbers that a product gathers at once.
CELLS = 4 << 20
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


class Grams:
    """Distinct n-grams of whole texts; the work space is kept between texts."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of the distinct n-grams of a lower-cased text."""
        a = np.frombuffer(text, np.uint8).astype(np.uint32)
        found = []
        for at in range(0, max(len(a), 1), BATCH_BYTES):
            part = a[at : at + BATCH_BYTES + 3]
            code, parts = part, []
            for n in ORDERS:
                if len(part) < n:
                    break
                code = (code[: len(part) - n + 1] << np.uint32(8) | part[n - 1 :]) if n > 1 else part
                parts.append(((code + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
            if parts:
                found.append(self.distinct(np.concatenate(parts)))
        return found[0] if len(found) == 1 else self.distinct(np.concatenate(found)) if found else np.zeros(0, np.uint32)

    def distinct(self, x: np.ndarray) -> np.ndarray:
        """One of each: the last position that wrote to a number's place."""
        order = np.arange(len(x), dtype=np.int32)
        self.last[x] = order
        return x[self.last[x] == order]


class Model:
    """Languages, the n-grams of landmarks, and for each of them its weight in each language's score."""

    def __init__(self, rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """rows: distinct n-grams of each training text."""
        self.langs = sorted(set(langs))
        self.place = None
        self.used = np.zeros(0, np.uint32)
        if not self.langs:
            return
        own = {g: [i for i, x in enumerate(langs) if x == g] for g in self.langs}
        order = [i for k in range(max(map(len, own.values()))) for g in self.langs for i in own[g][k : k + 1]]
        marks = [rows[i] for i in order[: max(landmarks, LEAST_LANDMARKS * len(self.langs))]]
        self.used = np.unique(np.concatenate(marks))
        z = np.zeros((len(self.used), len(marks)), np.float32)
        for j, m in enumerate(marks):
            z[np.searchsorted(self.used, m), j] = 1
        z /= np.sqrt(np.maximum(z.sum(axis=0), 1))
        phi = self.products(rows, z).astype(np.float64)
        values, vectors = np.linalg.eigh(self.products(marks, z).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K_mm^(-1/2), up to a rotation
        phi = np.column_stack([phi @ root, np.ones(len(rows))])
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        penalty = ridge * len(rows) * np.eye(phi.shape[1])
        penalty[-1, -1] = 0
        w = np.linalg.solve(phi.T @ phi + penalty, phi.T @ target)
        by = root @ w[:-1]
        self.weights = np.concatenate([z[at : at + (1 << 14)].astype(np.float64) @ by for at in range(0, len(z), 1 << 14)])
        self.bias = w[-1]

    def products(self, rows: list[np.ndarray], by: np.ndarray) -> np.ndarray:
        """Presence rows of unit length, times a matrix with a row for each used n-gram."""
        if self.place is None:
            self.place = np.full(1 << BITS, -1, np.int32)
            self.place[self.used] = np.arange(len(self.used))
        out = np.zeros((len(rows), by.shape[1]), by.dtype)
        most, held, n = max(1, CELLS // by.shape[1]), [], 0

        def sums() -> None:
            if held:
                starts = np.cumsum([0, *(len(p) for _, p in held[:-1])])
                out[[k for k, _ in held]] = np.add.reduceat(by[np.concatenate([p for _, p in held])], starts, axis=0)

        for k, r in enumerate(rows):
            p = self.place[r]
            p = p[p >= 0]
            if len(p) > most:
                for at in range(0, len(p), most):
                    out[k] += by[p[at : at + most]].sum(axis=0)
            elif len(p):
                if n + len(p) > most:
                    sums()
                    held, n = [], 0
                held.append((k, p))
                n += len(p)
        sums()
        return out / np.sqrt(np.maximum([len(r) for r in rows], 1)).astype(by.dtype)[:, None]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def predict(self, rows: list[np.ndarray]) -> tuple[list[str], list[float]]:
        """Best language and its share of the scores (softmax of the regression values, times 4)."""
        f = 4 * (self.products(rows, self.weights) + self.bias)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        best = f.argmax(axis=1)
        return [self.langs[i] for i in best], np.clip(e[np.arange(len(best)), best] / e.sum(axis=1), 0, 1).tolist()


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(lang, key, text): at most per_language different documents of each of the most frequent languages, those with the
    smallest digests of id and text. Null languages and texts without a letter are left out.

    Digests are uniform: twice a language's wanted share of them holds enough documents, so rows are thinned before they
    meet, and rows that repeat an id and its text are one.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.col(text))))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), key.alias("key"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = written(sizes, "langid-sizes").select(F.col("lang").alias("of"), "n")
    few = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of"))  # at most `languages` rows
    few = few.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("n") <= F.lit(2.0 * per_language * (1 << 32)))
    once = few.groupBy("lang", "key").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return once.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model from labelled(doc_id, text, lang), by the whole texts of sample(); the distinct n-grams of those reach the
    driver. Without a usable row the model knows no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            rows = [np.sort(grams.numbers(t.lower().encode())).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["lang", "key", "grams"])

    got = sample(labelled, per_language, text=text, lang=lang, doc_id=doc_id).mapInArrow(released(run), "lang string, key string, grams array<int>").toArrow()
    got = got.sort_by([("key", "ascending"), ("lang", "ascending")])
    rows = [x.values.to_numpy().astype(np.uint32) for x in got.column("grams")]
    return Model(rows, got.column("lang").to_pylist(), landmarks)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of docs with the predicted language of each whole text and its score (0 to 1); `und` and 0 where text is
    null or has no letter, or no language was learned. Repeated rows are judged each; an empty table gives none. A column
    of docs with one of the result's names raises ValueError: give other names."""
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value, Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                b = whole.slice(at, BATCH_DOCS)
                langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
                texts = b.column(text).to_pylist()
                known = [i for i, t in enumerate(texts) if t and m.langs and has_letter(t)]
                if known:
                    for i, g, s in zip(known, *m.predict([grams.numbers(texts[i].lower().encode()) for i in known])):
                        langs[i], scores[i] = g, s
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(released(run), schema)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
