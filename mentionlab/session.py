"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "mentionlab", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow).

    On a cluster the session comes from the launcher; nothing in the library overrides its settings, but for the size of
    batches while a table is written (small_batches).
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a shuffle is laid out by the number of rows.
TASK_ROWS = 500_000


def parts(df: DataFrame) -> int:
    """Tasks for a shuffle of df's rows: the session's number, and more for more rows, so that no task grows with the input.
    It costs a count of df (of a table: its files' footers)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


_own: str | None = None
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, once for a session, where they would not find it by their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root:
        return
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "mentionlab"), "zip", root, "mentionlab"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session gets a temporary one;
    a cluster is refused, since its executors would write where nobody else can read."""
    global _own
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or tempfile.mkdtemp(prefix="mentionlab-")  # the setting is fixed once a session runs
    return _own


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with the given ones and clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = f"_{name}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Folders of open scratch() blocks, innermost last.
_scratch: list[str] = []


#: Bytes of rows that go to a Python worker together while a table is written: executors and workers hold several copies.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside the block send rows to Python in batches of BATCH_BYTES, or of the session's own size if it is smaller."""
    before = spark.conf.get(BATCH_SETTING, None)
    digits = (before or "").removesuffix("b")
    if digits.isdigit() and 0 < int(digits) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, is computed once and outlives executors."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was computed from them is written itself."""
    for t in tables:
        if path := getattr(t, "_written_path", None):
            _delete(t.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """All tables written inside the block live in one folder of the shared one, which goes when the block ends: results
    must be read or written elsewhere before that."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield path
    finally:
        _scratch.remove(path)
        _delete(spark, path)
