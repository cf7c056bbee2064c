"""The streamed variant of ingestion: micro-batches of landed files, exactly once by the stream's checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mentionlab.session import shared_dir


def first_by_key(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of a stream whose key is new, of a micro-batch's rows of one key the first by `order` (nulls first). The keys
    that were seen are the stream's state, in its checkpoint; rows with a null key are left out."""
    schema = stream.schema

    def first(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        if not state.exists:
            for part in parts:
                both = part if best is None else pd.concat([best, part])
                best = both.sort_values(order, na_position="first", kind="stable").head(1)
            state.update((True,))
        else:
            for _ in parts:
                pass
        if best is not None:
            yield best[schema.names]

    return stream.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(first, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> None:
    """Appends the rows of a stream whose key is new to the table at `path`, the first of each by `order`. A micro-batch
    reads its own rows and the state of its keys, never the table; a batch that is run again after a failure writes its
    rows once, by the table's log of batches. The table is the stream's: both live and go together."""
    query = first_by_key(stream, key, order).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


#: How often a failed window is tried.
TRIES = 3
_LEDGER = "tag string, window string, status string, tries int, n_returned long, at timestamp"


def window_ledger(outcomes: DataFrame, tries: int = TRIES, wait_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """The ledger of a stream of fetches outcomes(tag, window, status, n_returned, at): a row whenever a window's state
    changes. `ok` and `absent` are final. A failed window becomes `retry` when event time has passed its last failure by
    wait_ms, and `given up` once it has failed `tries` times. State is a status, a count and a time for each window that is
    not final; late outcomes of a final window change nothing."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failed, at = state.get if state.exists else ("open", 0, 0)
        out = []
        if state.hasTimedOut:
            state.update(("retry", failed, at))
            out.append((*key, "retry", failed, None, pd.Timestamp(at + wait_ms, unit="ms")))
        else:
            rows = pd.concat(list(parts)).sort_values("at", kind="stable")
            for r in rows.itertuples():
                if status in ("ok", "absent", "given up"):
                    break
                at = int(r.at.value // 1_000_000)
                failed += r.status == "failed"
                status = r.status if r.status in ("ok", "absent") else "given up" if failed >= tries else "failed"
                out.append((*key, status, failed, None if pd.isna(r.n_returned) else int(r.n_returned), r.at))
            state.update((status, failed, at))
            if status == "failed":
                state.setTimeoutTimestamp(max(at + wait_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["tag", "window", "status", "tries", "n_returned", "at"]).astype({"n_returned": "Int64"})

    marked = outcomes.where("tag IS NOT NULL AND window IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    return marked.groupBy("tag", "window").applyInPandasWithState(step, _LEDGER, "status string, failed int, at long", "append", GroupStateTimeout.EventTimeTimeout)


def streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, counted by day and type: each micro-batch is written once, and the ledger of the stream
    is its checkpoint. Late rows are all taken: the final state of the complete aggregate is read back."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the reader of streams wants a folder: the file's name is its filter
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    daily = stream.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    out, check = (f"{shared_dir(spark)}/stream-{k}-{uuid.uuid4().hex}" for k in ("out", "check"))
    query = daily.writeStream.outputMode("complete").option("checkpointLocation", check).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
