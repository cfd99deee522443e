"""Tables on a shared file system: formats, staged overwrite, appends, partition refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.align import align

FORMATS = ("delta", "parquet", "csv")
EMPTY_MARK = "\x01"


def _check(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {FORMATS}")
    return fmt


def format_of(path: str, fallback: str = "parquet") -> str:
    """The format named by the extension, else ``fallback``."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    return suffix if suffix in FORMATS else _check(fallback)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, target, _ = _files(spark, path)
    return fs.exists(target)


def scan_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Lazy scan; an unknown format raises."""
    fmt = _check(fmt) if fmt else format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # Read as text and cast afterwards, so a bad value is null and not an error. A quoted
        # empty text is marked, as the reader would otherwise take it for a missing one.
        df = reader.option("header", True).option("emptyValue", EMPTY_MARK).load(path)
        df = df.replace(EMPTY_MARK, "")
        return align(df, schema) if schema else df
    if schema is not None and fmt != "delta":
        reader = reader.schema(schema)
    return reader.load(path)


def load_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None
) -> DataFrame:
    """The stored table in the target schema; a missing one is an empty frame."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    fmt = _check(fmt) if fmt else format_of(path)
    # The schema goes to the reader too: it names the types of partition columns, which a reader
    # would else guess from their text, and it lets a table without any file be read.
    return align(scan_table(spark, path, schema, fmt), schema)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    fmt = _check(fmt) if fmt else format_of(path)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_table(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: list[str] | None = None
) -> DataFrame:
    """Overwrite a table that ``df`` may itself be reading.

    The new rows go to a folder next to the target, which then takes its place; the old one is
    removed last, and comes back if the new one cannot take its place.
    """
    spark = df.sparkSession
    fmt = _check(fmt) if fmt else format_of(path)
    if fmt == "delta":
        # The transaction log already keeps readers and writers apart.
        write_table(df, path, fmt, partition_by)
        return scan_table(spark, path, None, fmt)
    mark = uuid.uuid4().hex
    staged, retired = f"{path}.new-{mark}", f"{path}.old-{mark}"
    write_table(df, staged, fmt, partition_by)
    fs, target, jvm = _files(spark, path)
    had_one = fs.exists(target)
    if had_one and not fs.rename(target, jvm.org.apache.hadoop.fs.Path(retired)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        if had_one:
            fs.rename(jvm.org.apache.hadoop.fs.Path(retired), target)
        raise OSError(f"cannot move {staged} to {path}")
    if had_one:
        fs.delete(jvm.org.apache.hadoop.fs.Path(retired), True)
    return scan_table(spark, path, df.schema, fmt)


def save_unless_empty(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Save by extension, or by ``fmt``; an empty frame leaves no file."""
    if df.isEmpty():
        return False
    write_table(df, path, format_of(path, fmt))
    return True


def append_rows(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: list[str] | None = None
) -> None:
    write_table(df, path, fmt, partition_by, mode="append")


def append_missing(
    df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None
) -> None:
    """Append only rows whose key is not stored yet."""
    spark = df.sparkSession
    if table_exists(spark, path):
        stored = scan_table(spark, path, df.schema, "parquet").select(*keys).distinct()
        df = df.join(stored, keys, "left_anti")
    append_rows(df, path, "parquet", partition_by)


def refresh_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    (
        df.write.format("parquet")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .save(path)
    )


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders of a stored table, named as Spark names the files in them."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def append_facts(facts: DataFrame, table: str, metadata: dict) -> None:
    """Append facts to a catalog table with filing metadata as constant columns."""
    facts.withColumns({k: F.lit(v) for k, v in metadata.items()}).write.mode("append").saveAsTable(
        table
    )


def append_string_facts(rows: DataFrame, table: str) -> None:
    rows.write.mode("append").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


class VectorTable:
    """Records with a vector of fixed length in a Parquet table."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path, dim

    def read(self) -> DataFrame:
        from factloom.schemas import VECTOR_RECORD

        return load_table(self.spark, self.path, VECTOR_RECORD)

    def add(self, documents: DataFrame, today: str) -> None:
        from factloom.operators.vectors import prepare_records

        append_rows(prepare_records(documents, self.dim, today), self.path, "parquet")

    def clear(self) -> None:
        from factloom.schemas import VECTOR_RECORD

        write_table(self.spark.createDataFrame([], VECTOR_RECORD), self.path, "parquet")
