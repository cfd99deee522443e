"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # One HTML document can be many megabytes, so keep Arrow batches short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "factloom", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must be able to read it. A session on one machine without the setting gets a
    folder of its own; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that the scopes entered last to first have to remove.
_SCOPES: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in this application's part of the shared folder.

    The file system removes that part when the driver ends, and a ``scratch_scope`` removes what was
    made in it when it is left; ``keep`` hands the path to the scope around that one.
    """
    folder = f"{shared_folder(spark)}/factloom-{spark.sparkContext.applicationId}"
    files, target = _file_system(spark, folder)
    if not files.exists(target):
        files.mkdirs(target)
        files.deleteOnExit(target)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    owners = _SCOPES[:-1] if keep else _SCOPES
    if owners:
        owners[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end, but for those that are kept.

    For steps that write their result: nothing lazy that reads the tables may leave the scope.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            files, target = _file_system(spark, path)
            files.delete(target, True)


def cut_lineage(df, label: str, keep: bool = False):
    """Write ``df`` to the shared folder and read it back.

    The files outlive any executor, and later passes read them instead of
    repeating the work.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    own = f"/factloom-{spark.sparkContext.applicationId}/"
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if own in folder:
            files, target = _file_system(spark, folder)
            files.delete(target, True)
