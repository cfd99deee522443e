"""Nearest neighbours by inner product over several shifted Hilbert orderings.

Vectors get one more component that makes all norms equal, so that the largest inner product is the
nearest point. Each curve turns them to a few axes of its own, shifts and cuts these into a grid,
and orders all rows by their place on the Hilbert curve through it. Spark partitions the rows of a
curve by ranges of that key; runs of rows that follow each other form blocks. A query meets the rows
of its own block and of the neighbouring blocks on every curve; what it finds on all of them is
merged and ranked by the inner product of the original vectors.

How many neighbouring blocks are read is measured, not guessed: for a bounded sample of queries the
true neighbours are found by comparison with all rows, and the window is the smallest that holds the
wanted share of them. On vectors without structure this window grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage

NEIGHBOURS, CURVES, AXES, BITS, BLOCK = 20, 8, 6, 8, 1024
#: Vectors that axes are scaled on, queries whose true neighbours are looked up, and the share of
#: these neighbours that the windows must hold.
FITTED, MEASURED, WANTED = 4096, 64, 0.95
TASK_BITS, SEED = 33, 5
#: Queries that meet the rows of a block in one task.
QUERIES = 4096


class Curve(NamedTuple):
    """Axes in the columns; a coordinate is cut at ``low`` with cells of ``step``."""

    axes: np.ndarray
    low: np.ndarray
    step: np.ndarray


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits per coordinate.

    The transposed form of Skilling's public description, for all points at once.
    """
    x = cells.astype(np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    bit = np.uint64(1 << (bits - 1))
    while bit > one:
        below = bit - one
        for k in range(axes):
            high = (x[k] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[k]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[k] ^= swap
        bit >>= one
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    bit = np.uint64(1 << (bits - 1))
    while bit > one:
        turn ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
        bit >>= one
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for k in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << one) | ((x[axis] >> np.uint64(k)) & one)
    return key.astype(np.int64)


def levelled(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that all rows have the squared norm ``most``."""
    rest = np.sqrt(np.maximum(most - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def fit_curves(sample: np.ndarray, most: float, curves: int, axes: int, bits: int) -> list[Curve]:
    rng, out = np.random.default_rng(SEED), []
    points = levelled(sample, most)
    width = min(axes, points.shape[1])
    for _ in range(curves):
        turned, _ = np.linalg.qr(rng.standard_normal((points.shape[1], width)))
        seen = points @ turned
        spread = np.maximum(seen.std(axis=0), 1e-9) * 8
        low = seen.mean(axis=0) - spread * rng.uniform(0.4, 0.6, width)
        out.append(Curve(turned, low, spread / (1 << bits)))
    return out


def curve_keys(vectors: np.ndarray, most: float, curves: list[Curve], bits: int) -> np.ndarray:
    points = levelled(vectors, most)
    out = []
    for curve in curves:
        cells = np.floor((points @ curve.axes - curve.low) / curve.step)
        out.append(hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits))
    return np.stack(out, axis=1)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(float)


def best_pairs(
    queries: np.ndarray,
    query_ids: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    count: int,
    floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``count`` rows of another id with the largest products, ties by id.

    Rows whose product is below the query's ``floor`` may be left out.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    product = queries @ rows.T
    product[query_ids[:, None] == ids[None]] = -np.inf
    least = np.full(len(queries), -np.inf)
    if product.shape[1] > count:
        least = np.partition(product, -count, axis=1)[:, -count]
    if floor is not None:
        least = np.maximum(least, floor)
    slack = 1e-9 * np.maximum(np.abs(np.where(np.isfinite(least), least, 0)), 1)
    who, what = np.nonzero((product >= (least - slack)[:, None]) & np.isfinite(product))
    exact = (queries[who] * rows[what]).sum(axis=1)
    order = np.lexsort((ids[what], -exact, who))
    who, what, exact = who[order], what[order], exact[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank < count
    return query_ids[who[keep]], ids[what[keep]], exact[keep]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` of rows that take part.

    Vectors that are null, empty or all zero, or that hold null or non-finite components, and rows
    without a key take no part.
    """
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def _merged(pairs: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = pairs.dropDuplicates(["query_id", "vec_id"])
    ranked = once.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= count)


PAIRS = "query_id long, vec_id long, score double"


def _frame(who: np.ndarray, what: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": who, "vec_id": what, "score": score})


def exact_neighbours(rows: DataFrame, queries: list, count: int) -> DataFrame:
    """The true neighbours of a bounded list of queries (``id``, ``vector``), from all rows."""
    ids = np.array([q["id"] for q in queries], dtype=np.int64)
    matrix = np.array([q["vector"] for q in queries], dtype=float)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = best_pairs(
                    matrix, ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), count
                )
                yield pa.RecordBatch.from_pandas(_frame(*found), preserve_index=False)

    return _merged(rows.select("id", "vector").mapInArrow(compare, PAIRS), count)


def index(rows: DataFrame, curves: list[Curve], most: float, bits: int, block: int) -> DataFrame:
    """``curve, block, id, vector, asked``: all rows in the order of every curve, in even blocks."""

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(curve_keys(_matrix(vectors), most, curves, bits)))

    every = rows.withColumn("keys", keys("vector"))
    every = every.select("id", "asked", F.posexplode("keys").alias("curve", "key"))
    every = cut_lineage(every, "curve-keys")
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        every.repartitionByRange(parts, "curve", "key", "id")
        .sortWithinPartitions("curve", "key", "id")
        .select("curve", "id", "asked", F.monotonically_increasing_id().alias("at"))
    )
    placed = cut_lineage(placed, "curve-order")
    task = F.shiftright("at", TASK_BITS)
    counts = placed.groupBy(task.alias("task"), "curve").agg(F.count("*").alias("n"))
    # One row per task and curve; how many there are does not follow the rows.
    before = Window.partitionBy("curve").orderBy("task")
    begun = counts.withColumn("begin", F.sum("n").over(before) - F.col("n"))
    first = placed.groupBy(task.alias("task"), "curve").agg(F.min("at").alias("first"))
    places = begun.join(first, ["task", "curve"]).select("task", "curve", "begin", "first")
    rank = F.col("begin") + F.col("at") - F.col("first")
    return cut_lineage(
        placed.withColumn("task", task)
        .join(places, ["task", "curve"])
        .select("curve", F.floor(rank / block).cast("long").alias("block"), "id", "asked"),
        "curve-blocks",
    )


def window_for(
    blocks: DataFrame, rows: DataFrame, count: int, measured: int, wanted: float
) -> int:
    """Blocks to read on either side, so that the measured queries find the wanted share."""
    asked = rows.filter("asked").orderBy(F.xxhash64("id"), "id").limit(measured)
    queries = asked.select("id", "vector").collect()
    truth = cut_lineage(exact_neighbours(rows, queries, count), "true-neighbours")
    mine = blocks.join(
        F.broadcast(truth.select(F.col("query_id").alias("id")).distinct()), "id"
    ).select(F.col("id").alias("query_id"), "curve", F.col("block").alias("own"))
    theirs = blocks.join(
        F.broadcast(truth.select(F.col("vec_id").alias("id")).distinct()), "id"
    ).select(F.col("id").alias("vec_id"), "curve", "block")
    steps = (
        truth.join(mine, "query_id")
        .join(theirs, ["vec_id", "curve"])
        .groupBy("query_id", "vec_id")
        .agg(F.min(F.abs(F.col("block") - F.col("own"))).alias("steps"))
        .groupBy("steps")
        .count()
        .orderBy("steps")
        .collect()
    )
    total, seen = sum(r["count"] for r in steps), 0
    for row in steps:
        seen += row["count"]
        if seen >= wanted * total:
            return row["steps"]
    return 0


def _meetings(asked: DataFrame, stored: DataFrame, groups: int, meet) -> DataFrame:
    """``meet`` for the queries and the rows of each block, the queries dealt into ``groups``.

    A block of rows goes to each group, so a task holds a bounded number of both.
    """
    part = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = asked.withColumn("part", part).groupBy("on", "at", "part")
    right = stored.select("curve", "block", "id", "vector", every.alias("part"))
    return left.cogroup(right.groupBy("curve", "block", "part")).applyInPandas(meet, PAIRS)


def nearest(
    vectors: DataFrame,
    asked: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    count: int = NEIGHBOURS,
    curves: int = CURVES,
    axes: int = AXES,
    bits: int = BITS,
    block: int = BLOCK,
    measured: int = MEASURED,
    wanted: float = WANTED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: neighbours of the rows that ``asked`` (on ``id``) holds.

    The row's own id is no neighbour of it; equal products go to the smaller id. Of rows with the
    same vector only the first ``count + 1`` ids can be anyone's neighbours, so only these and the
    queries are indexed. Vectors of another length than most take no part, repeated rows count once,
    an empty table gives no rows, other columns are left out.
    """
    spark = vectors.sparkSession
    found = usable(vectors, key, vector)
    sizes = found.groupBy(F.size("vector").alias("size")).count()
    top = sizes.orderBy(F.col("count").desc(), "size").first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if top is None:
        return nothing
    same = Window.partitionBy("vector").orderBy("id")
    found = found.filter(F.size("vector") == top["size"]).dropDuplicates(["id", "vector"])
    found = cut_lineage(found.withColumn("asked", asked), "usable")
    # A plain limit, which each task applies before it sends rows of a common vector anywhere.
    first = found.withColumn("same", F.row_number().over(same)).filter(F.col("same") <= count + 1)
    every = first.drop("same").union(found.filter("asked"))
    rows = cut_lineage(every.dropDuplicates(["id", "vector"]), "vectors")
    if rows.filter("asked").isEmpty():
        return nothing
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = float(rows.agg(F.max(square)).first()[0])
    sample = rows.select("vector").orderBy(F.xxhash64("id")).limit(FITTED).collect()
    fitted = fit_curves(
        np.array([r["vector"] for r in sample], dtype=float), most, curves, axes, bits
    )
    blocks = index(rows, fitted, most, bits, block)
    steps = window_for(blocks, rows, count, measured, wanted)

    stored = blocks.select("curve", "block", "id", "asked").join(rows.select("id", "vector"), "id")

    def meet(queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(near):
            return _frame(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float)))
        left, right = _matrix(queries["query"]), _matrix(near["vector"])
        own, ids = queries["query_id"].to_numpy(), near["id"].to_numpy()
        floor = queries["floor"].to_numpy()
        parts = [
            best_pairs(left[part], own[part], right, ids, count, floor[part])
            for part in (slice(k, k + block) for k in range(0, len(left), block))
        ]
        return _frame(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    # Queries meet their own blocks first. What they find there bounds what can still matter, so
    # the neighbouring blocks return only rows that are at least as near.
    own = stored.filter("asked").select("curve", "block", "id", "vector")
    lowest = F.lit(float("-inf"))
    first = own.toDF("on", "at", "query_id", "query").withColumn("floor", lowest)
    near = _merged(_meetings(first, stored, 1, meet), count)
    near = cut_lineage(near.select("query_id", "vec_id", "score"), "own-blocks")
    bounds = near.groupBy("query_id").agg(
        F.when(F.count("*") >= count, F.min("score")).otherwise(lowest).alias("floor")
    )
    reach = F.sequence(F.greatest(F.lit(0), F.col("block") - steps), F.col("block") + steps)
    around = F.filter(reach, lambda b: b != F.col("block"))
    sent = own.select("curve", F.explode(around), "id", "vector")
    sent = sent.toDF("on", "at", "query_id", "query").join(bounds, "query_id", "left")
    sent = sent.withColumn("floor", F.coalesce("floor", lowest))
    most_asked = sent.groupBy("on", "at").count().agg(F.max("count")).first()[0] or 0
    more = _meetings(sent, stored, max(1, -(-most_asked // QUERIES)), meet)
    return _merged(near.union(more), count).select("query_id", "rank", "vec_id", "score")
