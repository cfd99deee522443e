"""Annotation workflow: records, value items, latest states, fact matches, paging.

Ids are spelled out from the natural key (file, line, item), so they are the
same on every run and need no counter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.constants import CANONICAL_TAGS
from factloom.functions.text import int_or_null
from factloom.operators.align import align, first_per_key
from factloom.operators.coverage import tag_table
from factloom.schemas import ANNOTATIONS, SOURCE_RECORDS, VALUE_ITEMS

PENDING, ANNOTATED, VERIFIED = "pending", "annotated", "verified"


def record_id(file_name: Column, index: Column) -> Column:
    return F.concat(file_name, F.lit("#"), index.cast("string"))


def source_records(lines: DataFrame) -> DataFrame:
    """Records of good lines: ``file_name, record_index, record_json, ticker, fy``."""
    return align(
        lines.withColumns(
            {
                "record_id": record_id(F.col("file_name"), F.col("record_index")),
                "fy": int_or_null(F.col("fy")),
            }
        ),
        SOURCE_RECORDS,
    )


def value_items(lines: DataFrame) -> DataFrame:
    """Items of the good lines, in ``items``; lines without a list give none.

    The value is spelled as text: absent gives nothing, null gives None, true gives True.
    """
    own = record_id(F.col("file_name"), F.col("record_index")).alias("record_id")
    items = lines.select(own, F.posexplode("items").alias("item_index", "item"))
    return align(
        items.select(
            "record_id",
            "item_index",
            record_id(F.col("record_id"), F.col("item_index")).alias("item_id"),
            F.col("item.tag").alias("original_tag"),
            F.col("item.value").alias("original_value"),
            F.col("item.units").alias("original_units"),
            F.col("item.comments").alias("original_comments"),
            F.col("item.json").alias("item_json"),
        ),
        VALUE_ITEMS,
    )


def new_rows(
    incoming: DataFrame, existing: DataFrame | None, keys: list[str], *order: Column
) -> DataFrame:
    """Insert-or-ignore: incoming rows whose key is not stored yet, the first of equal ones."""
    fresh = first_per_key(incoming, keys, *order) if order else incoming.dropDuplicates(keys)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*keys).distinct(), keys, "left_anti")


def pending_shells(items: DataFrame, annotations: DataFrame | None) -> DataFrame:
    """A pending annotation for every item that has none."""
    shells = items.select("item_id").distinct().withColumn("status", F.lit(PENDING))
    if annotations is not None:
        shells = shells.join(annotations.select("item_id").distinct(), "item_id", "left_anti")
    return align(shells, ANNOTATIONS)


def latest_state(events: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """Current state per key from an append-only event table: the latest event wins."""
    return first_per_key(events, [key], *newest_first)


def newest_saves() -> list[Column]:
    """The order of saves, newest first; of equal times the one that sorts last in its columns."""
    rest = [f.name for f in ANNOTATIONS if f.name not in ("item_id", "updated_at")]
    return [F.col(c).desc_nulls_last() for c in ("updated_at", *rest)]


def upsert_annotations(current: DataFrame, saves: DataFrame) -> DataFrame:
    """Saved values replace the stored row of the same item; unknown items are added."""
    newest = latest_state(align(saves, ANNOTATIONS), "item_id", *newest_saves())
    kept = current.join(newest.select("item_id"), "item_id", "left_anti")
    return align(kept, ANNOTATIONS).unionByName(newest)


def items_with_annotations(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """All items, with value, comment and status of their annotation where there is one."""
    right = annotations.select("item_id", "annotated_value", "annotation_comment", "status")
    return items.join(right, "item_id", "left")


def prefill(items: DataFrame) -> DataFrame:
    """Values shown first: annotated, else original; comment else empty; status else pending."""
    return items.withColumns(
        {
            "shown_value": F.coalesce("annotated_value", "original_value"),
            "shown_comment": F.coalesce("annotation_comment", F.lit("")),
            "shown_status": F.when(F.col("status") != "", F.col("status")).otherwise(PENDING),
        }
    )


MATCHED, NO_MATCH, UNMAPPED = "matched", "no_match", "unmapped"


def match_items_to_facts(
    items: DataFrame, facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS
) -> DataFrame:
    """Facts that may back each item: its tag's concepts, same ticker, same report year.

    ``items`` carries ``ticker`` and ``fy``. Facts of other concepts are left
    out before the shuffle; items without a mapped tag and items without a fact
    stay, told apart by ``outcome``. Both sides are read once; heavy keys of the
    items can be split, and a concept has few facts of a ticker and year.
    """
    keys = ["tag", "ticker", "fy"]
    concepts = F.broadcast(tag_table(items.sparkSession, tags))
    candidates = (
        facts.join(concepts, "concept_name")
        .withColumn("fy", F.year("report_date").cast("bigint"))
        .filter(F.col("fy").isNotNull())
        .withColumn("__met", F.lit(True))
    )
    wanted = items.withColumnRenamed("original_tag", "tag")
    known = F.coalesce(F.col("tag").isin(list(dict.fromkeys(tags.values()))), F.lit(False))
    outcome = (
        F.when(F.col("__met"), F.lit(MATCHED))
        .when(known, F.lit(NO_MATCH))
        .otherwise(F.lit(UNMAPPED))
    )
    return wanted.join(candidates, keys, "left").withColumn("outcome", outcome).drop("__met")


def record_ids(records: DataFrame, file_name: str) -> DataFrame:
    return (
        records.filter(F.col("file_name") == file_name)
        .orderBy("record_index")
        .select("record_id", "record_index")
    )


def get_record(records: DataFrame, wanted: str) -> DataFrame:
    return records.filter(F.col("record_id") == wanted)


def items_of_record(items: DataFrame, annotations: DataFrame, wanted: str) -> DataFrame:
    chosen = items.filter(F.col("record_id") == wanted)
    return items_with_annotations(chosen, annotations).orderBy("item_index")


def file_names(records: DataFrame) -> DataFrame:
    return records.select("file_name").distinct().orderBy("file_name")


def neighbours(records: DataFrame) -> DataFrame:
    """Previous and next record of each record within its file.

    Line numbers rise within a file, so a file is cut into ranges of lines
    that are sorted on their own; a range borrows its first and last record
    from the ranges next to it.
    """
    span = 100_000
    ranged = records.select(
        "file_name", "record_id", "record_index", F.floor(F.col("record_index") / span).alias("part")
    )
    edges = ranged.groupBy("file_name", "part").agg(
        F.min_by("record_id", "record_index").alias("head"),
        F.max_by("record_id", "record_index").alias("tail"),
    )
    across = Window.partitionBy("file_name").orderBy("part")
    edges = edges.select(
        "file_name",
        "part",
        F.lag("tail").over(across).alias("tail_before"),
        F.lead("head").over(across).alias("head_after"),
    )
    inside = Window.partitionBy("file_name", "part").orderBy("record_index")
    return (
        ranged.join(edges, ["file_name", "part"])
        .withColumns(
            {
                "previous_id": F.coalesce(F.lag("record_id").over(inside), "tail_before"),
                "next_id": F.coalesce(F.lead("record_id").over(inside), "head_after"),
            }
        )
        .select("file_name", "record_id", "record_index", "previous_id", "next_id")
    )
