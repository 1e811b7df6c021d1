"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings every job expects. Only runtime settings: cluster sizing
# (executors, memory, shuffle partitions) stays with whoever submits the job.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "tallyback", conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking it from the session when it is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Where that is
    unset, as in tests, the session's warehouse folder is used on any master:
    the one other place that driver and executors share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Ends a statement by deleting its own shuffle files, instead of whenever the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = {"lock": threading.Lock(), "statements": 0, "before": "false"}


@contextmanager
def _shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """The setting while a statement runs; of several threads the first sets it and the last restores it."""
    with _cleaning["lock"]:
        if not _cleaning["statements"]:
            _cleaning["before"] = spark.conf.get(SHUFFLE_CLEANUP, "false")
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _cleaning["statements"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["statements"] -= 1
            if not _cleaning["statements"]:
                spark.conf.set(SHUFFLE_CLEANUP, _cleaning["before"])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from that table.

    Unlike recomputed lineage the table survives lost executors, and unlike a
    checkpointed row set it is compressed, its columns can be pruned, and its
    size is known to the planner. The shuffle files behind it go as soon as it
    is written; ``release`` deletes the table itself.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


ROWS_PER_PART = 1_000_000  # rows of the largest table for one partition of a shuffle
PART_BYTES = "16m"


@contextmanager
def shuffles_for(rows: DataFrame) -> Iterator[None]:
    """Statements run inside shuffle into as many partitions as the rows of ``rows`` call for, the session's number at least.

    With a fixed number the memory and the spill of a task grow with the tables. Small tables change nothing.
    """
    conf = rows.sparkSession.conf
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: conf.get(key) for key in (parts, size)}
    wanted = -(-rows.count() // ROWS_PER_PART)
    if wanted <= int(before[parts]):
        yield
        return
    conf.set(parts, str(wanted))
    conf.set(size, PART_BYTES)  # else small shuffles are read by as few tasks as before
    try:
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` that nothing will read again."""
    for table in tables:
        path = getattr(table, "kept_at", None)
        if path:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
