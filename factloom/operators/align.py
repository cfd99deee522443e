"""Schema alignment, unions and first-row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order: absent ones null, others cast, bad values null."""
    have = dict(df.dtypes)
    return df.select(
        *[
            (
                F.lit(None).cast(f.dataType)
                if f.name not in have
                else F.col(f.name)
                if have[f.name] == f.dataType.simpleString()
                else F.col(f.name).try_cast(f.dataType)
            ).alias(f.name)
            for f in schema
        ]
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def stack_aligned(schema: T.StructType, *frames: DataFrame) -> DataFrame:
    """Vertical concat after alignment."""
    out = align(frames[0], schema)
    for frame in frames[1:]:
        out = out.unionByName(align(frame, schema))
    return out


def stack_columns(*frames: DataFrame) -> DataFrame:
    """Diagonal concat: the union of all columns, absent ones null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """The first row of each key under a total order.

    The rank filter is planned as a group limit before the shuffle, so a key
    with a third of all rows sends one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def last_per_key(df: DataFrame, keys: Sequence[str | Column], position: str) -> DataFrame:
    return first_per_key(df, keys, F.col(position).desc())
