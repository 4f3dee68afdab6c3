"""Session helpers: a default session for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(
    name: str = "sensorloom",
    cpus: int | str = "*",
    partitions: int = 8,
    settings: Mapping[str, str] | None = None,
) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.config(map=dict(settings or {}))
        .master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the session.

    Only a local-mode session may fall back to a temporary folder: on a cluster that would be a
    different folder on each machine. So may be any folder of the local file system unless it is a
    mount that the machines share, which is tried before it is used.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        if not local and not reaches_all(spark, folder):
            refuse_machine_local(spark, folder)
        return folder
    if not local:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sensorloom-"))
    return context.getCheckpointDir()


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path of the session's file systems, and the file system it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _in_local_files(spark: SparkSession, path: str) -> bool:
    return _folder(spark, path)[1].getUri().getScheme() == "file"


# Tasks for each core that write when a folder is tried: enough for every executor at hand to get some.
TRIAL_TASKS = 2

_tried: set[tuple[str, str]] = set()


def reaches_all(spark: SparkSession, path: str) -> bool:
    """Whether the driver sees what the tasks of the executors write below a path.

    Other file systems than the local one are taken to be shared. A local path is tried by one small job, once for each
    application, whose files are counted by the driver.
    """
    context = spark.sparkContext
    own = (context.applicationId, path)
    if own in _tried or not _in_local_files(spark, path):
        return True
    tasks = TRIAL_TASKS * context.defaultParallelism
    trial = f"{path.rstrip('/')}/sensorloom-{context.applicationId}/trial-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(trial)
        seen = len(spark.read.schema("id long").parquet(trial).inputFiles())
    finally:
        remove_folder(spark, trial)
    if seen == tasks:
        _tried.add(own)
    return seen == tasks


def refuse_machine_local(spark: SparkSession, path: str) -> None:
    if _in_local_files(spark, path):
        folder = _folder(spark, path)[0]
        raise ValueError(f"{folder} is on one machine; set {CHECKPOINT_SETTING} to a shared folder")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if there is one."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


_open_copies: list[list[str]] = []


@contextmanager
def released_copies(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block every copy that was stored in it.

    Results that read such copies must have been written or collected by then. Copies stored outside a
    block are deleted when the application ends.
    """
    _open_copies.append([])
    try:
        yield
    finally:
        for path in _open_copies.pop():
            remove_folder(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under a folder of this application that is removed with it."""
    own = f"{shared_folder(spark).rstrip('/')}/sensorloom-{spark.sparkContext.applicationId}"
    folder, system = _folder(spark, own)
    system.deleteOnExit(folder)
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    if _open_copies:
        _open_copies[-1].append(path)
    return path


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Later stages start from that table, whatever executors are lost meanwhile. It is columnar, so
    they read only the columns they use, which a checkpoint of the rows would not allow.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
