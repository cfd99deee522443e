"""SimHash near-duplicates by a tiled exact comparison of all fingerprints.

Equal fingerprints are counted as one first. The others are dealt into tiles by their population
count; two fingerprints within the radius differ in population count by no more than the radius, so
tile pairs further apart are never formed. A task compares one pair of tiles with numpy's exclusive
or and bit counts. Inside it both tiles are sorted by the population counts of their 16-bit parts
and cut into short runs; pairs of runs whose counts differ by more than the radius are skipped as
well. A task returns a spanning forest of the links it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered
from factloom.llm.components import components
from factloom.session import cut_lineage

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, of a run within a tile, and shingles whose bits are counted at once.
TILE, RUN, COUNTED = 65_536, 128, 65_536


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half the hashes of all word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(end + 1 for end in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(last), COUNTED):
        spans = zip(starts[k : k + COUNTED], last[k : k + COUNTED], strict=False)
        hashes = np.array([hashed(flat[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit number; 0 for null and for texts without words."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(x, shingle, seed) for x in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return prints(text)


def hexadecimal(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def _runs(tile: np.ndarray) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """The tile sorted by the population counts of its parts; its runs and their least and most."""
    counts = np.bitwise_count(tile.view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T[::-1])
    counts, cuts = counts[order], range(0, len(tile), RUN)
    low = np.array([counts[k : k + RUN].min(axis=0) for k in cuts])
    high = np.array([counts[k : k + RUN].max(axis=0) for k in cuts])
    return tile[order], [slice(k, k + RUN) for k in cuts], low, high


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join all fingerprints within the radius; one per node at most."""
    same = left is right
    a, a_runs, a_low, a_high = _runs(left)
    b, b_runs, b_low, b_high = (a, a_runs, a_low, a_high) if same else _runs(right)
    label = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    for x, run in enumerate(a_runs):
        gap = np.maximum(np.maximum(b_low - a_high[x], a_low[x] - b_high), 0).sum(axis=1)
        for y in np.flatnonzero(gap <= radius):
            if same and y < x:
                continue
            near = np.bitwise_count(a[run, None] ^ b[None, b_runs[y]]) <= radius
            i, j = np.nonzero(near)
            one, two = label[i + run.start], label[j + b_runs[y].start + shift]
            apart = one != two
            if apart.any():
                _union(label, one[apart], two[apart])
    nodes = np.concatenate([a, b]) if not same else a
    linked = np.flatnonzero(label != np.arange(len(label)))
    return nodes[linked], nodes[label[linked]]


def _union(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Join the classes of ``label`` that the pairs link; a class is named by its least member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for p, q in np.unique(np.stack([one, two], axis=1), axis=0).tolist():
        p, q = root(p), root(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
    moved = np.array(list(parent))
    target = np.arange(len(label))
    target[moved] = [root(x) for x in moved.tolist()]
    label[:] = target[label]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints that join all those within the radius.

    ``prints`` holds distinct numbers in ``fingerprint``. The counts of the 65 population classes
    decide how many tiles a class has; only these counts pass through the driver.
    """
    spark = prints.sparkSession
    count = F.bit_count("fingerprint").cast("int")
    classes = prints.groupBy(count.alias("bits")).count().collect()
    parts = {row["bits"]: -(-row["count"] // tile) for row in classes}
    if not parts:
        return spark.createDataFrame([], "a long, b long")
    tiles_of = F.element_at(
        F.create_map(*[F.lit(x).cast("int") for item in sorted(parts.items()) for x in item]),
        F.col("bits"),
    )
    tiles = cut_lineage(
        prints.select("fingerprint", count.alias("bits"))
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), tiles_of).cast("int"))
        .groupBy("bits", "part")
        .agg(F.collect_list("fingerprint").alias("prints")),
        "tiles",
    )
    counted = spark.createDataFrame(sorted(parts.items()), "bits int, parts int")
    ahead = (
        counted.select("bits", "parts", F.explode(F.sequence("bits", F.col("bits") + radius)))
        .withColumnRenamed("col", "other")
        .join(counted.select(F.col("bits").alias("other"), F.col("parts").alias("others")), "other")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("from", F.when(F.col("other") == F.col("bits"), F.col("part")).otherwise(0))
        .withColumn("mate", F.explode(F.sequence(F.col("from"), F.col("others") - 1)))
        .select("bits", "part", "other", "mate")
    )
    first = tiles.select("bits", "part", F.col("prints").alias("left"))
    second = tiles.select(
        F.col("bits").alias("other"), F.col("part").alias("mate"), F.col("prints").alias("right")
    )
    pairs = ahead.join(second, ["other", "mate"]).join(first, ["bits", "part"])
    lone = (F.col("bits") == F.col("other")) & (F.col("part") == F.col("mate"))
    pairs = pairs.select("left", F.when(~lone, F.col("right")).alias("right"))
    # A pair is much work for its bytes, so the number of tasks is set and not left to the sizes.
    number = sum(
        n * parts.get(other, 0) if other > bits else n * (n + 1) // 2
        for bits, n in parts.items()
        for other in range(bits, bits + radius + 1)
    )
    cores = spark.sparkContext.defaultParallelism
    tasks = min(number, max(4 * cores, number // 16))
    pairs = pairs.repartition(tasks, F.xxhash64("left", "right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left = batch["left"][k].values.to_numpy().view(np.uint64)
                right = batch["right"][k]
                right = right.values.to_numpy().view(np.uint64) if right.is_valid else left
                a, b = forest(left, right, radius)
                yield pa.record_batch(
                    [pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"]
                )

    return pairs.mapInArrow(compare, "a long, b long")


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fingerprint, root``: the class of each distinct fingerprint, named by one member."""
    distinct = prints.select("fingerprint").distinct()
    linked = components(fingerprint_links(distinct, radius, tile))
    return distinct.join(
        linked.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """``key, fingerprint, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest key that can be reached over links. Null texts count as empty;
    texts without words have fingerprint 0, which is linked like any other. A null key counts as
    larger than all others: its class is named by another key, or null if it has none. Repeated rows
    are returned as often as they come; all other columns are left out.
    """
    prints = cut_lineage(
        docs.select(F.col(key), fingerprint(F.col(text)).alias("fingerprint")), "prints"
    )
    least = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    named = least.join(fingerprint_classes(prints, radius, tile), "fingerprint")
    named = cut_lineage(named, "classes")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fingerprint", "root").join(roots, "root").drop("root")
    return prints.join(classes, "fingerprint").select(key, "fingerprint", "component_id")


def first_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """The rows of ``docs`` that come first in their class, by key and then by place.

    All columns stay. The first of a class has the smallest key; null keys come last.
    """
    rows = cut_lineage(
        numbered(docs).withColumn("__print", fingerprint(F.col(text))), "rows"
    )
    short = rows.select(ROW, F.col(key).alias("key"), F.col("__print").alias("fingerprint"))
    classes = fingerprint_classes(short, radius, tile)
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col(ROW))
    # The first row of each fingerprint is found before classes are joined to it.
    heads = short.groupBy("fingerprint").agg(F.min(order).alias("head"))
    kept = heads.join(classes, "fingerprint").groupBy("root").agg(F.min("head").alias("head"))
    kept = kept.select(F.col(f"head.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").drop(ROW, "__print")
