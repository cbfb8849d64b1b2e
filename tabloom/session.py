"""Spark session and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the JVM leaves methods above this many bytes of code to its interpreter.
JIT_METHOD_BYTES = "8000"
# What a Python worker is handed at once: texts can be long, so rows alone are no measure.
ARROW_BATCH_BYTES = str(4 << 20)

MERGE_WAYS = 64

_local_folder: str | None = None
_lock = threading.RLock()
_shipped: set[str] = set()
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_derived: dict[tuple[str, str, str], str] = {}


def tune_session(spark: SparkSession) -> None:
    """Settings that a session made elsewhere may lack.

    Times are read as UTC.  Wide projections fall back to many small generated
    methods: one method with dozens of expressions is never compiled by the
    JVM, and runs several times slower.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def build_session(app_name: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    ``master`` is for local runs; on a cluster it comes from the submit
    command, like every setting not named here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES)
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.host", "127.0.0.1")
            .config("spark.driver.bindAddress", "127.0.0.1")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without that setting; it then gets a temporary
    folder.  On a cluster a machine-local folder would lose the data together
    with the machine, so a missing setting is an error there.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="tabloom-")
    return _local_folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_folder(spark), "tabloom", f"{label}-{uuid.uuid4().hex}")


def write_and_reread(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder, with ``options`` of the writer.

    A written table is computed once and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(table: DataFrame) -> None:
    """Let a table from `write_and_reread` go: out of the cache, and its files deleted.

    For loops that write one version of a table after the other, once nothing reads the old one.
    """
    table.unpersist()
    path = _written.pop(table, None)
    if path:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merged(partial: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of the summaries that tasks emit, per key, in two levels.

    There is a summary for every input split, so the first level adds up those
    of a share of the splits, and no task of the second reads more than
    ``MERGE_WAYS`` rows for a key.
    """
    way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS))
    first = partial.withColumn("_way", way).groupBy(*keys, "_way").agg(*[F.sum(c).alias(c) for c in sums])
    return first.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package: functions that run in Python workers are found by its name there.

    Once per application; a session started from any working folder will do.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabloom-code-"), "tabloom.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in sorted(os.walk(root)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("tabloom", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)


def derive_once(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` gives for ``source``, written at the first call of an application and read from then on.

    It has the parts that its last join or scan has; its rows are not dealt anew, which for a wide
    table costs more than all else.  A source that changes under its path is not noticed within an
    application.
    """
    key = (spark.sparkContext.applicationId, name, source)
    with _lock:
        if key not in _derived:
            path = shared_path(spark, name)
            build().write.parquet(path)
            _derived[key] = path
    return spark.read.parquet(_derived[key])


@contextmanager
def reused(df: DataFrame):
    """Keep ``df`` for the passes of one operator, and let it go afterwards.

    It lies on the executors' disks, as wide rows in memory would take the heap that the passes need,
    and is rebuilt from its source when an executor goes, so it is a matter of speed only.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def narrow_rows(spark: SparkSession, row_bytes: int):
    """Leave out the limit on the bytes of an Arrow batch while batches of ``row_bytes`` wide rows cannot reach it.

    With a limit Spark adds up the buffers of a batch after every row, which costs as much as writing the
    row.  The limit on rows holds, so batches are the same.  It is a setting of the session: jobs of other
    threads see it too.
    """
    rows, limit = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), "spark.sql.execution.arrow.maxBytesPerBatch"
    if rows <= 0 or rows * row_bytes > int(ARROW_BATCH_BYTES):
        yield
        return
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(limit, before)
