"""Annotation saves that arrive as JSON files, taken up in incremental runs."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from factloom.operators.align import align
from factloom.operators.annotations import latest_state
from factloom.schemas import ANNOTATIONS
from factloom.sources.tables import load_table

# Send the helpers with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What the state of an item holds: its latest save, times as microseconds so that none are rounded.
_FIELDS = [f.name for f in ANNOTATIONS if f.name not in ("item_id", "updated_at")]
_SAVE = "micros long, " + ", ".join(f"`{n}` string" for n in _FIELDS)
_TRACKED = f"item_id string, {_SAVE}"


def _rank(save: tuple) -> tuple:
    """The order of saves: by time, then by the other columns; what is missing comes first."""
    return tuple((value is not None, value) for value in save)


def _latest(key, frames, state):
    """The latest of the held save and all new ones, if it is a new one."""
    held = tuple(state.get) if state.exists else None
    best = held
    for frame in frames:
        for micros, *rest in frame[["micros", *_FIELDS]].itertuples(index=False):
            known = [None if pd.isna(v) else v for v in rest]
            save = (None if pd.isna(micros) else int(micros), *known)
            if best is None or _rank(save) > _rank(best):
                best = save
    if best is not None and best != held:
        state.update(best)
        rows = [(key[0], *best)]
        yield pd.DataFrame(rows, columns=["item_id", "micros", *_FIELDS])


def track_saves(
    spark: SparkSession, source: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Take up all new files and write the states that changed, then stop.

    The latest save of each item is held as state from batch to batch, so a save that comes late is
    compared with it and older ones are not read again. A batch writes at most one row per item, in
    a folder of its own that a repeated batch replaces.
    """
    saves = align(spark.readStream.schema(ANNOTATIONS).json(source), ANNOTATIONS)
    told = saves.filter("item_id is not null").select(
        "item_id",
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("micros"),
        *[F.col(n).cast("string").alias(n) for n in _FIELDS],
    )
    states = told.groupBy("item_id").applyInPandasWithState(
        _latest, _TRACKED, _SAVE, "update", GroupStateTimeout.NoTimeout
    )

    def write(batch, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(target)
        )

    return (
        states.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_states(spark: SparkSession, target: str) -> DataFrame:
    """The state of each item: the row of the last batch that changed it."""
    kept = load_table(spark, target, _tracked_schema(spark), "parquet")
    last = latest_state(kept, "item_id", F.col("batch").desc())
    kind = ANNOTATIONS["updated_at"].dataType
    time = F.timestamp_micros("micros").cast(kind)
    return align(last.withColumn("updated_at", time), ANNOTATIONS)


def _tracked_schema(spark: SparkSession):
    return spark.createDataFrame([], f"{_TRACKED}, batch int").schema


def absorb_saves(
    spark: SparkSession, source: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Append all files that are new since the last run, then stop.

    Each batch replaces its own partition, so a batch that is repeated after a
    failure leaves the same rows. The state is read with ``latest_state``.
    """
    saves = spark.readStream.schema(ANNOTATIONS).json(source)

    def write(batch, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(target)
        )

    return (
        saves.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
