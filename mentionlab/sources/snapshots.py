"""Versioned tables in a folder: a new version is whole or not there, readers take the last one or that of a time."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(version, milliseconds since 1970 when it was made) of the versions that are there, oldest first."""
    system, p = _system(spark, folder)
    if not system.exists(p):
        return []
    found = [s.getPath().getName() for s in system.listStatus(p)]
    parts = [n.split("-") for n in found if n.startswith("v-") and n.count("-") == 2]
    return sorted((int(v), int(t)) for _, v, t in parts)


def write_snapshot(df: DataFrame, folder: str, at: dt.datetime | None = None) -> int:
    """Writes df as the next version and returns its number. It is written aside and renamed: a failed job leaves no version,
    and of two writers of one number the second fails."""
    spark = df.sparkSession
    own = f"{folder}/_new-{uuid.uuid4().hex}"
    df.write.parquet(own)
    system, source = _system(spark, own)
    known = versions(spark, folder)
    number = known[-1][0] + 1 if known else 1
    made = int((at or dt.datetime.now(dt.timezone.utc)).timestamp() * 1000)
    _, claim = _system(spark, f"{folder}/_claim-{number}")
    try:
        system.create(claim, False).close()
    except Exception as e:
        system.delete(source, True)
        raise RuntimeError(f"version {number} is being written by someone else") from e
    if not system.rename(source, _system(spark, f"{folder}/v-{number}-{made}")[1]):
        raise RuntimeError(f"version {number} could not be put in place")
    return number


def read_snapshot(spark: SparkSession, folder: str, at: dt.datetime | None = None) -> DataFrame:
    """The last version, or the last one made by a time; ValueError where there is none."""
    until = None if at is None else int(at.timestamp() * 1000)
    some = [(v, t) for v, t in versions(spark, folder) if until is None or t <= until]
    if not some:
        raise ValueError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/v-{some[-1][0]}-{some[-1][1]}")


def update_outcomes(spark: SparkSession, folder: str, outcomes: DataFrame, key: str = "article_id", at: dt.datetime | None = None) -> int:
    """A new version of the table in which rows that `outcomes` has, by key, carry its columns and the time of coding as
    coded_at; other rows and columns are as they were. Outcomes have a row for each key; rows of new keys are not added."""
    table = read_snapshot(spark, folder)
    values = [c for c in outcomes.columns if c != key]
    new = outcomes.select(F.col(key).alias("_key"), F.struct(*values).alias("_new"), F.lit(True).alias("_coded"))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    coded = F.lit(at or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    before = lambda c, kind: F.col(c) if c in table.columns else F.lit(None).cast(kind)
    made = {c: F.when(F.col("_coded"), F.col("_new")[c]).otherwise(before(c, outcomes.schema[c].dataType)) for c in values}
    made["coded_at"] = F.when(F.col("_coded"), coded).otherwise(before("coded_at", "timestamp"))
    return write_snapshot(joined.withColumns(made).drop("_key", "_new", "_coded"), folder, at)
