"""Folders that driver and executors share, and checkpoints in them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_base(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where none is set, a temporary one in local mode (tests), else an error."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if base:
        return base.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/sievework-shared"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the driver ends."""
    folder = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{folder}/data"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run inside remove their shuffle files as they end; these else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(REMOVAL, None)
    spark.conf.set(REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVAL)
        else:
            spark.conf.set(REMOVAL, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder; ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes it with its last use."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # the setting is read where a query is built


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
