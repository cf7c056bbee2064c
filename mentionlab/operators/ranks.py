"""Row numbers over a whole table without one task: ranges of the order, counted, numbered each for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlab.session import fresh, written


def numbered(rows: DataFrame, name: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """rows with their place (from 1) in an order over the whole table, as a long column `name`.

    Rows are laid out by ranges of the order and written with their range; what is summed over the ranges is one row for
    each. The order must tell rows apart (end it with a key): rows equal in it share a range and take any of its places,
    and an order whose rows are all equal would put them into one.
    """
    part, before = fresh(rows, "range", "before")
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranks")
    counts = laid.groupBy(part).agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select(part, F.coalesce(F.sum("c").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return laid.withColumn(name, own.cast("long")).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)
