"""Annotation store: ingest files, record saves, read the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.align import align
from factloom.operators.annotations import (
    items_with_annotations,
    latest_state,
    new_rows,
    newest_saves,
    pending_shells,
    prefill,
)
from factloom.schemas import ANNOTATIONS, SOURCE_RECORDS, VALUE_ITEMS
from factloom.session import cut_lineage
from factloom.sources.jsonl import numbered_lines, one_file_per_name, parse_lines, records_of
from factloom.sources.tables import append_rows, load_table


class AnnotationStore:
    """Three append-only tables below one folder.

    Saves are appended as events; the state of an item is its latest event, so
    a repeated or lost write never damages older rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.paths = {n: f"{folder}/{n}" for n in ("records", "items", "events")}

    def records(self) -> DataFrame:
        return load_table(self.spark, self.paths["records"], SOURCE_RECORDS)

    def items(self) -> DataFrame:
        return load_table(self.spark, self.paths["items"], VALUE_ITEMS)

    def events(self) -> DataFrame:
        return load_table(self.spark, self.paths["events"], ANNOTATIONS)

    def annotations(self) -> DataFrame:
        return latest_state(self.events(), "item_id", *newest_saves())

    def ingest(self, path: str) -> DataFrame:
        """Add new records and items of JSONL files; returns the rejected lines.

        Each line is parsed once, into a written batch that records, items and pending states all
        come from. Of files with one name one whole file is taken. What is stored stays as it is.
        """
        lines = one_file_per_name(numbered_lines(self.spark, path))
        records, items, rejected = records_of(cut_lineage(parse_lines(lines), "parsed"))
        shells = pending_shells(items, self.events())
        append_rows(
            new_rows(
                records,
                self.records(),
                ["file_name", "record_index"],
            ),
            self.paths["records"],
            "parquet",
        )
        append_rows(
            new_rows(
                items,
                self.items(),
                ["record_id", "item_index"],
            ),
            self.paths["items"],
            "parquet",
        )
        append_rows(shells, self.paths["events"], "parquet")
        return rejected

    def save(self, saves: DataFrame) -> None:
        """Append saves: item, value, comment, status; the time defaults to now."""
        stamped = saves
        if "updated_at" not in saves.columns:
            stamped = saves.withColumn("updated_at", F.current_timestamp())
        append_rows(align(stamped, ANNOTATIONS), self.paths["events"], "parquet")

    def worklist(self) -> DataFrame:
        """All items with the values an annotator sees first."""
        return prefill(items_with_annotations(self.items(), self.annotations()))
