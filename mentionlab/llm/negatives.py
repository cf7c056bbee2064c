"""Operator 12: hard negatives by a Voronoi-partitioned distributed kNN join.

Inner products become distances by one more component: a row x gets sqrt(M^2 - |x|^2), with M the largest norm, an anchor
q gets 0. Then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so the highest products are the nearest rows.

Rows go to the nearest of a bounded number of pivots. Each cell, sorted by distance to its pivot, is cut into blocks of
BLOCK_ROWS rows with the least and largest of these distances; anchors, likewise, into groups of GROUP_ANCHORS that know
their distance range to each pivot. By the triangle inequality a block can serve a group only if the range of distances
between the two meets the range that the group's anchors still ask for. A search has two passes: a group meets the blocks
of its own cell, which bounds what can still be better; then only those blocks of other cells that the bound lets through.
Where groups and blocks meet they are joined by one matrix product, exact on whole numbers, and an anchor keeps k rows of
each block, which are merged by a window.

Cells, blocks and groups of any size are spread over all tasks: equal rows, and cells with any share of the rows, are cut
like others. What is kept of all data together is pivots and distance ranges only. Where distances concentrate (random
vectors of many dimensions) no bound excludes much, and the join does most of the block products; it stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.llm.common import released, table, written

#: Pivots at most, and anchors for each pivot.
MAX_PIVOTS, LEAST_PIVOTS, ANCHORS_PER_PIVOT = 256, 8, 128
BLOCK_ROWS, GROUP_ANCHORS = 2048, 512
#: Searches of a group that are looked at together.
ASKED = 256
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
_LOW, _HIGH = -(1 << 62), 1 << 62

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of whole numbers; what a shorter row lacks is 0."""
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]).astype(int)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, exact_doubles: bool) -> np.ndarray:
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact_doubles else a.astype(np.int64) @ b.astype(np.int64).T


def _distances(rows: np.ndarray, pivots: np.ndarray, largest: float, anchors: bool) -> np.ndarray:
    """Of each row to each pivot, in the space with one more component."""
    rows = rows.astype(float)
    extra = lambda x: np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
    more = np.zeros(len(rows)) if anchors else extra(rows)
    a, p = np.column_stack([rows, more]), np.column_stack([pivots, extra(pivots)])
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * a @ p.T, 0))


def _placed(pivots: np.ndarray, largest: float, anchors: bool):
    """Adds the nearest pivot, the distance to it and, for anchors, to all."""
    dim = pivots.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(_matrix(batch.column(3), dim), pivots, largest, anchors)
            cell = far.argmin(1)
            more = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, *([pa.array(list(far), pa.list_(pa.float64()))] if anchors else [])], [*batch.schema.names, "cell", "dist", *(["far"] if anchors else [])])

    return run


def _packed(dim: int, most: int, wide: bool, anchors: bool):
    """Rows sorted by cell and distance as blocks of one cell with `most` rows at most."""
    kind = "<i8" if wide else "<i4"

    def run(batches):
        task, n, held = TaskContext.get().partitionId(), 0, None
        for batch in [*batches, None]:
            t = pa.Table.from_batches([batch]) if batch is not None else None
            held = t if held is None else pa.concat_tables([held, t]) if t is not None else held
            while held is not None and held.num_rows:
                cells = held.column("cell").to_numpy()
                end = min(int(np.searchsorted(cells, cells[0], "right")), most)
                if end == held.num_rows < most and batch is not None:
                    break  # more rows of the block may follow
                own, held = held.slice(0, end).combine_chunks(), held.slice(end)
                dist = own.column("dist").to_numpy()
                out = {"block": [(task << 32) + n], "cell": pa.array([cells[0]], pa.int32()), "least": [dist.min()], "most": [dist.max()]}
                out |= {c: pa.array([own.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "vec_id", "label")}
                out["rows"] = [_matrix(own.column("v").combine_chunks(), dim).astype(kind).tobytes()]
                if anchors:
                    far = np.array(own.column("far").to_pylist())
                    out |= {"lows": [far.min(0).tolist()], "highs": [far.max(0).tolist()]}
                n += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, list) else v for k, v in out.items()})

    return released(run)


_BLOCK = "block long, cell int, least double, most double, row array<long>, vec_id array<long>, label array<long>, rows binary"


def _met(dim: int, wide: bool, exact_doubles: bool, k: int, same: bool):
    """The k best rows of a block for each search of a group: highest product, then least id, null last."""
    kind = "<i8" if wide else "<i4"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                g, b = (np.frombuffer(r[c], kind).reshape(-1, dim) for c in ("a_rows", "rows"))
                scores = _products(g, b, exact_doubles)
                labels, ids = np.array(r["label"]), np.array([_HIGH * 2 - 1 if i is None else i for i in r["vec_id"]])
                a_labels, rows, a_rows = np.array(r["a_label"]), np.array(r["row"]), np.array(r["a_row"])
                order = np.lexsort((rows, ids))
                scores, labels, rows = scores[:, order], labels[order], rows[order]
                for at in range(0, len(r["of"]), ASKED):
                    of, ask = (np.array(r[c][at : at + ASKED]) for c in ("of", "ask"))
                    low, high = (np.array(r[c][at : at + ASKED])[:, None] for c in ("low", "high"))
                    s = scores[of]
                    fit = ((labels[None, :] == a_labels[of][:, None]) == same) & (rows[None, :] != a_rows[of][:, None]) & (s >= low) & (s <= high)
                    s = np.where(fit, s, _LOW * 2)
                    cut = np.maximum(np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else s.min(1), _LOW * 2 + 1)
                    i, j = np.nonzero(s >= cut[:, None])
                    o = np.lexsort((j, -s[i, j], i))  # equal scores stay in order of id
                    i, j = i[o], j[o]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[rank < k], j[rank < k]
                    if len(i):
                        yield pa.RecordBatch.from_pydict({
                            "a_row": pa.array(a_rows[of[i]]), "ask": pa.array(ask[i].astype(np.int32)), "score": pa.array(s[i, j]),
                            "n_id": pa.array([r["vec_id"][x] for x in order[j]], pa.int64()), "n_row": pa.array(rows[j]),
                        })

    return released(run)


_MET = "a_row long, ask int, score long, n_id long, n_row long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a_row", "ask").orderBy(F.col("score").desc(), F.col("n_id").asc_nulls_last(), "n_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Search:
    """Groups of anchors and blocks of rows that are searched."""

    def __init__(self, anchors: DataFrame, groups: DataFrame, blocks: DataFrame, dim: int, wide: bool, exact_doubles: bool, largest: float):
        self.anchors, self.groups, self.blocks, self.largest = anchors, groups, blocks, largest
        self.kinds = (dim, wide, exact_doubles)
        self.slack = 1e-6 * (1 + largest**0.5)

    def _distance(self, score: Column) -> Column:
        return F.sqrt(F.greatest(F.col("norm") + F.lit(self.largest) - 2 * score.cast("double"), F.lit(0.0)))

    def _run(self, asks: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        asked = asks.groupBy("group").agg(*[F.collect_list(c).alias(c) for c in ("of", "ask", "low", "high")])
        left = pairs.join(asked, "group").join(self.groups.select("group", "a_row", "a_label", "a_rows"), "group")
        met = left.join(self.blocks.select("block", "row", "vec_id", "label", "rows"), "block")
        return met.mapInArrow(_met(*self.kinds, k, same), _MET)

    def best(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """For each search (a_row, ask, low, high): the k best rows with a product from low to high, whose label is the anchor's
        or (same=False) is not."""
        asks = asks.join(self.anchors, "a_row")
        ranges = self.blocks.select("block", "cell", "least", "most")
        cells = self.groups.select("group", F.col("cell").alias("own"), F.posexplode(F.arrays_zip("lows", "highs")).alias("cell", "far"))
        pairs = cells.join(ranges, "cell").withColumn("near", F.greatest(F.col("far.lows") - F.col("most"), F.col("least") - F.col("far.highs"), F.lit(0.0))).withColumn("farthest", F.col("far.highs") + F.col("most"))
        first = _best(self._run(asks, pairs.where("cell = own").select("group", "block"), k, same), k)
        first = written(first.drop("rank"), "negatives-first")
        kth = first.groupBy("a_row", "ask").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        limits = asks.join(kth, ["a_row", "ask"], "left").select("group", self._distance(F.greatest("low", F.coalesce("kth", "low"))).alias("far"), self._distance(F.col("high")).alias("near"))
        limits = limits.groupBy("group").agg(F.max("far").alias("asks_far"), F.min("near").alias("asks_near"))
        others = pairs.where("cell <> own").join(limits, "group").where((F.col("near") <= F.col("asks_far") + self.slack) & (F.col("farthest") >= F.col("asks_near") - self.slack))
        return _best(first.unionByName(self._run(asks, others.select("group", "block"), k, same)), k)


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers, floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its `positives` best rows of the same label: the best `negatives` rows of other labels
    whose product with the anchor is from low to high percent of the positive's. Columns: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Products are of components floor(scale * x); higher ones come first, equal ones by smaller id, a null id last. Rows with
    a null label, a null vector or a component that is null or not finite take no part; components that a shorter vector
    lacks are 0. Rows that repeat an id are rows of their own, also as anchors. No anchor, no positive or an empty table: no
    rows. Products beyond 62 bits raise ValueError. Other columns are not looked at.
    """
    spark = rows.sparkSession
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.col(label).isNotNull() & v.isNotNull() & finite)
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(v, scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    kept = written(kept, "negatives-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = kept.agg(F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("largest"), F.max(norm).alias("norm"), F.count_if("anchor").alias("anchors")).first()
    if not facts.anchors or not facts.dim:
        return spark.createDataFrame([], _RESULT)
    if facts.norm >= 1 << 62:
        raise ValueError("products would not fit into 62 bits")
    wide, exact, dim = facts.largest >= 1 << 31, facts.norm < 1 << 52, facts.dim
    n = min(MAX_PIVOTS, max(LEAST_PIVOTS, facts.anchors // ANCHORS_PER_PIVOT))
    chosen = [r.v for r in kept.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(n).collect()]
    pivots = np.unique(np.array([x + [0] * (dim - len(x)) for x in chosen], float), axis=0)
    columns = "row long, vec_id long, label long, v array<long>, cell int, dist double"
    data = kept.select("row", "vec_id", "label", "v")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(df: DataFrame, most: int, anchors: bool) -> DataFrame:
        placed = df.mapInArrow(_placed(pivots, facts.norm, anchors), columns + (", far array<double>" if anchors else ""))
        laid = placed.repartitionByRange(tasks, "cell", "dist", "row").sortWithinPartitions("cell", "dist", "row")
        return laid.mapInArrow(_packed(dim, most, wide, anchors), _BLOCK + (", lows array<double>, highs array<double>" if anchors else ""))

    blocks = written(packed(data, BLOCK_ROWS, False), "negatives-blocks")
    groups = written(packed(kept.where("anchor").select("row", "vec_id", "label", "v"), GROUP_ANCHORS, True), "negatives-groups")
    groups = groups.select(F.col("block").alias("group"), "cell", "lows", "highs", F.col("row").alias("a_row"), F.col("label").alias("a_label"), F.col("rows").alias("a_rows"))
    anchors = groups.select("group", F.posexplode("a_row").alias("of", "a_row")).join(kept.where("anchor").select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"), norm.alias("norm")), "a_row")
    anchors = written(anchors, "negatives-anchors")
    search = _Search(anchors.drop("anchor_id"), groups, blocks, dim, wide, exact, facts.norm)
    asks = anchors.select("a_row", F.lit(0).alias("ask"), F.lit(_LOW).cast("long").alias("low"), F.lit(_HIGH).cast("long").alias("high"))
    found = search.best(asks, positives, True).select("a_row", F.col("rank").cast("int").alias("ask"), F.col("n_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = written(found, "negatives-positives")
    score = F.col("positive_score")
    asks = found.select("a_row", "ask", (-_floor_div(-low * score, 100)).alias("low"), _floor_div(high * score, 100).alias("high")).where("low <= high")
    hard = search.best(asks, negatives, False).select("a_row", "ask", F.col("rank").cast("int").alias("rank"), F.col("n_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(found, ["a_row", "ask"]).join(anchors.select("a_row", "anchor_id"), "a_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""
