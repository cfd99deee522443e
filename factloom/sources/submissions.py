"""Filing indexes stored as columnar JSON: arrays keyed by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.align import stack_columns
from factloom.operators.filings import align_raw, rows_from_columnar
from factloom.schemas import RAW_FILING

KEEP = ["cik", "source_rank", "file_name", "position"]


def array_schema(extra: list[str] = ()) -> T.StructType:
    """Arrays of text for the six fixed fields and any extra ones."""
    names = [*RAW_FILING.fieldNames(), *extra]
    return T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names])


def _document(extra) -> T.StructType:
    arrays = array_schema(extra)
    recent = T.StructType([T.StructField("recent", arrays)])
    return T.StructType([*arrays.fields, T.StructField("filings", recent)])


def _unnamed(value: Column, named: list[str], kind: str) -> Column:
    """The fields of a JSON object that nobody named, those of ``kind`` as they can be read."""
    fields = F.from_json(value, "map<string,string>")
    others = F.map_filter(fields, lambda name, text: ~name.isin(named) & text.startswith("["))
    return F.transform_values(others, lambda name, text: F.from_json(text, kind))


def filings_from_json(
    files: DataFrame, extra: list[str] = (), others: str | None = None
) -> DataFrame:
    """Raw filing rows of index documents: ``cik, source_rank, file_name`` and ``value`` as JSON.

    The arrays stand at the root or under ``filings.recent``; the root counts
    if it holds a list of numbers. A root that is a list of objects gives a row
    per object. ``others`` names a column for all fields that are neither fixed
    nor in ``extra``: a map from the field to its text in the row.
    """
    arrays, named = array_schema(extra), [f.name for f in array_schema(extra)]
    kept = ["cik", "source_rank", "file_name"]
    parsed = files.select(*kept, "value", F.from_json("value", _document(extra)).alias("doc"))
    root = F.struct(*[F.col(f"doc.{f.name}") for f in arrays])
    at_root = F.col("doc.accessionNumber").isNotNull()
    chosen = F.when(at_root, root).otherwise(F.col("doc.filings.recent"))
    own = parsed.select(*kept, chosen.alias("arrays"), at_root.alias("at_root"), "value")
    carried = list(kept)
    if others:
        source = F.when(F.col("at_root"), F.col("value")).otherwise(
            F.get_json_object("value", "$.filings.recent")
        )
        own = own.withColumn("__others", _unnamed(source, named, "array<string>"))
        carried.append("__others")
    columnar = rows_from_columnar(own.select(*carried, "arrays"), "arrays", carried)
    rows = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in arrays]))
    objects = files.filter(F.ltrim("value").startswith("["))
    listed = (
        objects.select(*kept, "value", F.posexplode(F.from_json("value", rows)).alias("position", "row"))
        .withColumn("position", F.col("position").cast("bigint"))
    )
    if others:
        value = F.transform_values("__others", lambda name, texts: F.get(texts, F.col("position").cast("int")))
        columnar = columnar.withColumn(others, value).drop("__others")
        every = F.get(F.from_json("value", "array<map<string,string>>"), F.col("position").cast("int"))
        rest = F.map_filter(every, lambda name, text: ~name.isin(named))
        listed = listed.withColumn(others, rest)
    listed = listed.select(*kept, "position", "row.*", *([others] if others else []))
    return align_raw(stack_columns(columnar, listed), KEEP)


def read_submissions(
    spark: SparkSession, path: str, extra: list[str] = (), others: str | None = None
) -> DataFrame:
    """Raw rows of all index files below ``path``; ``others`` as in ``filings_from_json``.

    ``CIK##########.json`` holds the recent filings of a company and comes
    first; ``CIK##########-submissions-*.json`` are its archives, in order.
    """
    name = F.col("_metadata.file_name")
    cik = F.regexp_extract(name, r"CIK(\d+)", 1)
    files = spark.read.text(path, wholetext=True).select(
        F.lpad(cik, 10, "0").alias("cik"),
        F.when(name.contains("-submissions-"), F.lit(1)).otherwise(F.lit(0)).alias("source_rank"),
        name.alias("file_name"),
        "value",
    )
    return filings_from_json(files, extra, others)
