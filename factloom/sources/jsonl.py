"""Line-numbered text and JSONL records."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.annotations import source_records, value_items

# Send the helpers with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number from 0: ``file_name, file_path, line_index, value``.

    Each split of a file gets its first line number from the line counts of the
    splits before it. Only those counts are shuffled; the lines stay where they
    were read.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )
    counts = lines.groupBy("file_path", "block").agg(
        F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    before = (
        Window.partitionBy("file_path")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        "file_path",
        "block",
        "first_id",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    return lines.join(starts, ["file_path", "block"]).select(
        "file_name",
        "file_path",
        (F.col("start") + F.col("row_id") - F.col("first_id")).alias("line_index"),
        "value",
    )


def _text_or_none(value) -> str | None:
    """What a text column keeps of a value; lists and objects are an error."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bool, int)):
        return str(int(value))
    if isinstance(value, float):
        return repr(value)
    raise TypeError(type(value).__name__)


def _items(values) -> list[dict]:
    """Items up to the first that is no object or has a field that no text column can keep."""
    out = []
    for item in values if isinstance(values, list) else []:
        try:
            told = {name: _text_or_none(item.get(name)) for name in ("tag", "units", "comments")}
        except (AttributeError, TypeError):
            break
        out.append({**told, "value": str(item.get("value", "")), "json": json.dumps(item)})
    return out


def _parsed(line: str | None) -> dict:
    """One line as a JSON reader with Python's rules takes it: of equal keys the last one counts at
    every depth, NaN and Infinity are numbers, and nothing may follow the object."""
    try:
        record = json.loads(line or "")
        ticker, year = _text_or_none(record.get("ticker")), _text_or_none(record.get("fy"))
    except (ValueError, AttributeError, TypeError, RecursionError):
        return {"good": False, "ticker": None, "fy": None, "items": []}
    return {"good": True, "ticker": ticker, "fy": year, "items": _items(record.get("values"))}


PARSED = (
    "good boolean, ticker string, fy string,"
    " items array<struct<tag:string,units:string,comments:string,value:string,json:string>>"
)
_ITEM = pa.struct([(name, pa.string()) for name in ("tag", "units", "comments", "value", "json")])
_PARSED_TYPES = {
    "good": pa.bool_(), "ticker": pa.string(), "fy": pa.string(), "items": pa.list_(_ITEM),
}
#: Characters of lines that are parsed before their rows are handed on.
PARSED_AT_ONCE = 1 << 20


def _parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the columns of ``PARSED``, each of some lines only: what JSON makes of a line
    takes many times its length, so a whole batch would be held in as much memory."""

    def handed_on(part: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
        made = [
            pa.array([row[name] for row in rows], type=kind) for name, kind in _PARSED_TYPES.items()
        ]
        names = [*part.schema.names, *_PARSED_TYPES]
        return pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    for batch in batches:
        begin, size, rows = 0, 0, []
        for text in batch.column("value"):
            line = text.as_py()
            rows.append(_parsed(line))
            size += len(line or "")
            if size >= PARSED_AT_ONCE:
                yield handed_on(batch.slice(begin, len(rows)), rows)
                begin, size, rows = begin + len(rows), 0, []
        if rows:
            yield handed_on(batch.slice(begin, len(rows)), rows)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``good, ticker, fy, items``: the verdict and the values from one reading."""
    own = ", ".join(f"`{name}` {kind}" for name, kind in lines.dtypes)
    return lines.mapInArrow(_parsed_batches, f"{own}, {PARSED}")


def records_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, their value items, and the rejected lines, from what ``parse_lines`` made.

    Bad lines keep their line number, so they still count. All three read ``parsed``: whoever wants
    one reading writes it first.
    """
    good = parsed.filter("good").withColumnsRenamed(
        {"line_index": "record_index", "value": "record_json"}
    )
    rejected = parsed.filter(~F.col("good")).select("file_name", "line_index", "value")
    return source_records(good), value_items(good), rejected


def read_records(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, their value items, and the rejected lines."""
    return records_of(parse_lines(lines))


def one_file_per_name(lines: DataFrame) -> DataFrame:
    """Of files with one name the whole file with the least path; the others are left out."""
    first = lines.groupBy("file_name").agg(F.min("file_path").alias("file_path"))
    return lines.join(first, ["file_name", "file_path"], "left_semi")
