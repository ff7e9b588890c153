"""Session helpers shared by tests, the benchmark and library callers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_scope = threading.local()


def local_session(cores: str = "*", app: str = "urlrisk") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    The shared folder is set here where no Spark default names one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    if not spark.conf.get(_SETTING, None):
        spark.conf.set(_SETTING, os.path.join(tempfile.gettempdir(), "urlrisk-shared"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application inside the one every executor reaches, ``spark.checkpoint.dir``.

    There is no machine-local fallback: a job without the setting stops here.
    The folder goes when the application ends, or earlier with ``drop_shared``.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    folder = f"{base.rstrip('/')}/urlrisk-{spark.sparkContext.applicationId}"
    system, path = _file_system(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path for one written table or stream checkpoint; ``keep`` takes it out of the scratch around it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside go at the end, but for those that a registry or a store keeps for later use.

    Write results inside, to a path from outside: plans that were built here cannot run afterwards.
    """
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            drop_shared(spark, path)


def drop_shared(spark: SparkSession, path: str | None = None) -> None:
    """Delete one written table, or all of this application, once nothing reads it any more."""
    system, path = _file_system(spark, path or shared_folder(spark))
    system.delete(path, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the shared place; none if it does not exist."""
    system, path = _file_system(spark, folder)
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def materialize(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the optimizer
    true sizes, so a later join broadcasts only what is really small.
    """
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """One intermediate table that feeds several branches: written, so its source is read once."""
    return materialize(df, name)
