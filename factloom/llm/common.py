"""What several operators of this folder share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import factloom

ROW = "__row"
_SENT: set[str] = set()
#: Texts may be long, so what Python workers get at once is bounded in rows and in bytes. Operators
#: write each step's result, so the shuffle files behind it can go as soon as it is written.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}
#: Set where the session does not say: small shuffle partitions, so that tasks sort little at once
#: beside the Python workers.
UNLESS_SET = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def prepare(spark: SparkSession) -> None:
    """Settings for work on texts, and this package for Python workers, wherever the driver runs.

    The driver zips its own copy once per session and Spark hands that to all executors.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    for name, value in UNLESS_SET.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    session = spark.sparkContext.applicationId
    if session in _SENT:
        return
    home = Path(factloom.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(session)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def numbered(df: DataFrame) -> DataFrame:
    """A number for each row in ``__row``.

    The numbers hold for as long as the frame is computed once, so whoever uses them twice writes
    the frame to the shared folder first.
    """
    return df.drop(ROW).withColumn(ROW, F.monotonically_increasing_id())


def pieces(rows: Iterable, most: int) -> Iterable[list]:
    """Lists of ``most`` elements at most."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part
