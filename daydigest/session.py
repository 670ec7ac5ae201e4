"""Session settings, the shared work folder and the size check before a broadcast."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its rows times its row width stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts are long: the default would hand a Python worker hundreds of MB at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def ship(package: str) -> None:
    """Send functions of ``package`` to Python workers by value, so that executors need no
    copy of it on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[package])


ship("daydigest")


def build_session(app: str = "daydigest", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC times and adaptive execution; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """A session made elsewhere, with the settings that results and memory depend on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints and derived tables.

    Read from ``spark.checkpoint.dir``. A local session without one gets a fresh
    temporary folder; a cluster session without one is an error, because a folder
    of one machine is not visible to the executors.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="daydigest-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


# Paths handed out below the shared folder, by application.
_staged: dict[str, list[str]] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; ``release`` deletes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete this application's staged tables but the first ``keep``, and return how many paths that
    were; call it when the frames that read them have been used."""
    paths = _staged.get(spark.sparkContext.applicationId, [])
    gone, paths[keep:] = paths[keep:], []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Staged tables of the block are deleted at its end; use its results within it."""
    before = len(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written rows.

    The table survives lost executors, is computed once however often it is used, and
    its size is known to the planner, which broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """A table just read, in at least as many parts as there are cores.

    A few files, row groups or gzip members are read by as few tasks, and all work up to the next shuffle stays
    there. Such a table is dealt out row by row; one that is read in more parts than cores is left as it is, so
    no large table is shuffled for this. Rows are kept, and column pruning and filters still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows_up_to(df: DataFrame, limit: int) -> int:
    """Row count of a table that should be small; counting stops after ``limit`` + 1."""
    return df.limit(limit + 1).count()


def small_side(df: DataFrame, rows: int, row_bytes: int = 128) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows`` (a proven bound) keep it small.

    Above the bound the table is left unmarked, so the join shuffles both sides and
    adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def checked_small_side(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    """``small_side`` for a table that is cheap to count (a source or a checkpoint)."""
    limit = BROADCAST_BYTES // row_bytes
    return small_side(df, rows_up_to(df, limit), row_bytes)
