"""Vector records: defaults, exact search, cell-probed search, listing."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.constants import INDEX_PARTITIONS, LISTING_LIMIT, SEARCH_LIMIT
from factloom.functions.vectors import METRICS, fit_dimension, score
from factloom.operators.align import align
from factloom.schemas import VECTOR_RECORD

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a block on either side of a search for many queries.
RECORDS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 256
# Rows whose true neighbours say how far a search has to probe, and the share it has to reach.
MEASURED, REACHED = 64, 0.97


def prepare_records(documents: DataFrame, dim: int, today: str) -> DataFrame:
    """Fill in date and source, and bring each vector to ``dim`` numbers."""
    filled = documents
    for name, default in (("date", today), ("source", "unknown")):
        given = F.col(name) if name in documents.columns else F.lit(None)
        filled = filled.withColumn(name, F.coalesce(given.cast("string"), F.lit(default)))
    vector = F.col("vector").cast("array<float>")
    return align(filled.withColumn("vector", fit_dimension(vector, dim)), VECTOR_RECORD)


def list_documents(records: DataFrame, ticker: str, limit: int = LISTING_LIMIT) -> DataFrame:
    """The first ``limit`` records of a ticker in the order of their columns, without the vector."""
    listed = records.filter(F.col("ticker") == ticker).drop("vector")
    return listed.orderBy(*listed.columns).limit(limit)


def _distances(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rows by queries, in double precision; null where cosine has no direction."""
    products = block @ queries.T
    if metric == "dot":
        return 1.0 - products
    if metric == "l2":
        # Summed differences, not the expanded product, so equal vectors are at 0.
        return np.stack([((block - q) ** 2).sum(axis=1) for q in queries], axis=1)
    norms = np.sqrt((block**2).sum(axis=1))[:, None] * np.sqrt((queries**2).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - products / norms


def _checked(vector: str, dim: int) -> Column:
    """The vector, or an error where its length differs from that of the queries."""
    size = F.size(vector)
    words = F.concat(F.lit("a vector has length "), size.cast("string"), F.lit(f", queries {dim}"))
    return F.when(size == dim, F.col(vector)).otherwise(F.raise_error(words))


def _found_schema(kept: list[T.StructField]) -> T.StructType:
    return T.StructType(
        [T.StructField("query_id", T.LongType())]
        + kept
        + [T.StructField("distance", T.DoubleType())]
    )


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = set(pc.list_value_length(column).to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


class _Rows:
    """Rows that queries are compared with: their vectors, the order of their ids, what is shown."""

    def __init__(self, payload, ids, vectors):
        self.payload, self.matrix = payload, _matrix(vectors)
        self.order = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()

    def best(self, names, queries: np.ndarray, k: int, metric: str):
        """For each query the ``k`` nearest rows, as Arrow tables."""
        if len(self.matrix) and self.matrix.shape[1] != queries.shape[1]:
            raise ValueError(
                f"a vector has length {self.matrix.shape[1]}, queries {queries.shape[1]}"
            )
        distances = _distances(self.matrix, queries, metric)
        for j, name in enumerate(names):
            d = distances[:, j]
            usable = np.flatnonzero(~np.isnan(d))
            if len(usable) > k:
                bound = np.partition(d[usable], k - 1)[k - 1]
                usable = usable[d[usable] <= bound]
            best = usable[np.lexsort((self.order[usable], d[usable]))][:k]
            if len(best):
                picked = self.payload.take(pa.array(best))
                yield pa.table(
                    [
                        pa.array(np.full(len(best), name, dtype=np.int64)),
                        *picked.columns,
                        pa.array(d[best]),
                    ],
                    names=["query_id", *self.payload.schema.names, "distance"],
                )


def _known(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def _nearest(
    records: DataFrame, query: np.ndarray, id_col: str, vector_col: str, k: int, metric: str
) -> DataFrame:
    """The ``k`` rows of each batch that are nearest to one query, with ``distance``.

    Rows without a vector are left out; a vector of another length is an error.
    """
    _known(metric)
    kept = [f for f in records.schema if f.name != vector_col]
    names = [f.name for f in kept]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _Rows(batch.select(names), batch.column(id_col), batch.column(vector_col))
                for found in rows.best([0], query, k, metric):
                    yield from found.to_batches()

    whole = records.filter(F.col(vector_col).isNotNull())
    whole = whole.select(*names, _checked(vector_col, query.shape[1]).alias(vector_col))
    return whole.mapInArrow(search, _found_schema(kept))


def _parts(df: DataFrame, name: str, size: int) -> DataFrame:
    """``__cell`` and into how many blocks its rows go; there is a row for each cell."""
    return df.groupBy("__cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def _met(
    records: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, metric: str
) -> DataFrame:
    """The ``k`` nearest rows per query within each block of rows of the same ``__cell``.

    Queries (``query_id, query_vector``) are packed into blocks once. A block of rows stays in one
    task while the blocks of its cell's queries stream past it, so every vector is shuffled once, and
    of the queries one block for each block of rows. Both kinds of blocks are of bounded size,
    whatever cell most rows or queries have.
    """
    _known(metric)
    kept = [f for f in records.schema if f.name not in (vector_col, "__cell")]
    records = records.filter(F.col(vector_col).isNotNull())
    queries = queries.filter(F.col("query_vector").isNotNull())
    parts = _parts(records, "__parts", RECORDS_PER_BLOCK)
    groups = _parts(queries, "__groups", QUERIES_PER_BLOCK)

    left = records.withColumn("__at", F.monotonically_increasing_id()).join(parts, "__cell")
    part = F.pmod(F.xxhash64("__at"), F.col("__parts")).cast("int")
    row = F.struct(*[F.col(f.name) for f in kept], F.col(id_col).alias("__id"))
    left = left.select(
        "__cell", part.alias("part"), F.lit(0).alias("kind"), row.alias("row"),
        F.col(vector_col).alias("vector"), F.lit(None).cast("array<double>").alias("numbers"),
        F.lit(None).cast("array<bigint>").alias("asked"),
    )
    group = F.pmod(F.xxhash64("query_id"), F.col("__groups")).alias("group")
    packed = queries.join(groups, "__cell").groupBy("__cell", group)
    packed = packed.agg(F.collect_list(F.struct("query_id", "query_vector")).alias("q"))
    right = packed.join(parts, "__cell").select(
        "__cell",
        F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"),
        F.lit(1).alias("kind"),
        F.lit(None).alias("row"),
        F.lit(None).alias("vector"),
        F.flatten(F.transform("q", lambda x: x["query_vector"])).alias("numbers"),
        F.transform("q", lambda x: x["query_id"]).alias("asked"),
    )
    names = [f.name for f in kept]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, rows = None, [], None
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("__cell", "part", "kind")]
            keys = np.stack(columns, axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if tuple(keys[a][:2]) != place:
                    place, held, rows = tuple(keys[a][:2]), [], None
                piece = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    held.append(piece.select(["row", "vector"]))
                    continue
                if rows is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    row = table.column("row").combine_chunks()
                    fields = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
                    payload = pa.table([fields[n] for n in names], names=names)
                    rows, held = _Rows(payload, fields["__id"], table.column("vector")), []
                for j in range(len(piece) if rows else 0):
                    asked = piece.column("asked")[j].as_py()
                    flat = piece.column("numbers")[j].values.to_numpy(zero_copy_only=False)
                    if len(flat) % len(asked):
                        raise ValueError("query vectors of different lengths")
                    for found in rows.best(asked, flat.reshape(len(asked), -1), k, metric):
                        yield from found.to_batches()

    dealt = left.unionByName(right).repartition("__cell", "part")
    return dealt.sortWithinPartitions("__cell", "part", "kind").mapInArrow(stream, _found_schema(kept))


def _finish(candidates: DataFrame, id_col: str, limit: int, metric: str, min_score: float):
    """Best ``limit`` rows per query, scored; the score bound applies after the limit."""
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    best = candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    scored = best.withColumn("score", score(F.col("distance"), metric))
    if metric in ("cosine", "l2"):
        scored = scored.filter(F.col("score") >= min_score)
    return scored


def search(
    records: DataFrame,
    query: Sequence[float],
    ticker: str | None = None,
    limit: int = SEARCH_LIMIT,
    min_score: float = 0.0,
    metric: str = "l2",
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """Nearest rows to one query vector; the vector column is left out."""
    if ticker is not None:
        records = records.filter(F.col("ticker") == ticker)
    vector = np.asarray([query], dtype=np.float64)
    near = _nearest(records, vector, id_col, vector_col, limit, metric)
    best = near.drop("query_id").orderBy("distance", id_col).limit(limit)
    scored = best.withColumn("score", score(F.col("distance"), metric))
    if metric in ("cosine", "l2"):
        scored = scored.filter(F.col("score") >= min_score)
    return scored


def _queries(queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    return queries.select(
        F.col(query_id).cast("bigint").alias("query_id"),
        F.col(query_vector).cast("array<double>").alias("query_vector"),
    )


def search_many(
    records: DataFrame,
    queries: DataFrame,
    limit: int = SEARCH_LIMIT,
    min_score: float = 0.0,
    metric: str = "l2",
    id_col: str = "id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Nearest rows to each of many query vectors, exact.

    ``queries`` has a whole-number id and a vector per row and stays a table of any size; no query
    gives no rows. Vectors of different lengths are an error.
    """
    asked = _queries(queries, query_id, query_vector).withColumn("__cell", F.lit(0))
    found = _met(records.withColumn("__cell", F.lit(0)), asked, id_col, vector_col, limit, metric)
    return _finish(found, id_col, limit, metric, min_score)


def cell_count(rows: int, configured: int = INDEX_PARTITIONS) -> int:
    return min(configured, max(2, math.isqrt(rows)))


def assign_cells(
    records: DataFrame,
    vector_col: str = "vector",
    configured: int = INDEX_PARTITIONS,
    seed: int = 7,
) -> tuple[DataFrame, np.ndarray]:
    """Give each row the number of its k-means cell; also return the cell centres.

    There are at most ``configured`` centres, so they always fit the driver.
    Store the result with ``partitionBy("cell")`` to let a search skip cells.
    """
    featured = records.filter(F.col(vector_col).isNotNull()).withColumn(
        "__features", array_to_vector(F.col(vector_col).cast("array<double>"))
    )
    cells = cell_count(featured.count(), configured)
    model = KMeans(
        k=cells, seed=seed, featuresCol="__features", predictionCol="cell", maxIter=10
    ).fit(featured.select("__features"))
    return model.transform(featured).drop("__features"), np.asarray(model.clusterCenters())


def nearest_cells(
    vectors: Column, centres: np.ndarray, most: int, reach: float = 0.0, sizes=None, rows: int = 0
) -> Column:
    """The cells whose centres are nearest to a vector, nearest first.

    These are the first ``most``, all others that are no more than ``reach`` farther than the first,
    and, where the ``sizes`` of cells are given, as many as hold ``rows`` rows together.
    """
    known = np.asarray(centres, dtype=np.float64)
    held = np.zeros(len(known)) if sizes is None else np.asarray(sizes)

    @F.pandas_udf("array<int>")
    def cells(column: pd.Series) -> pd.Series:
        far = np.sqrt(_distances(known, np.stack(column.to_numpy()).astype(np.float64), "l2").T)
        order = far.argsort(axis=1, kind="stable")
        ahead = np.take_along_axis(far, order, axis=1)
        count = np.maximum((ahead <= ahead[:, :1] + reach).sum(axis=1), min(most, len(known)))
        if rows:
            short = (np.cumsum(held[order], axis=1) < rows).sum(axis=1)
            count = np.maximum(count, np.minimum(short + 1, len(known)))
        return pd.Series([o[:n].astype(np.int32) for o, n in zip(order, count, strict=True)])

    return cells(vectors)


def place_in_cells(records: DataFrame, centres: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """Rows with the number of their cell by centres that are known, as for rows that come later."""
    records = records.filter(F.col(vector_col).isNotNull())
    return records.withColumn("cell", nearest_cells(F.col(vector_col), centres, 1)[0])


def store_cells(indexed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows into a folder per cell; a large cell gets several files, small ones few."""
    indexed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(path)


def measured_reach(
    indexed: DataFrame,
    centres: np.ndarray,
    limit: int = SEARCH_LIMIT,
    sample: int = MEASURED,
    share: float = REACHED,
    metric: str = "l2",
    id_col: str = "id",
    vector_col: str = "vector",
) -> float:
    """How much farther than the nearest centre a search must go to find ``share`` of neighbours.

    ``sample`` rows, the first by hash of their id, are searched exactly; only their own vectors and
    the cells of their ``limit`` neighbours reach the driver.
    """
    asked = indexed.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col)
    asked = asked.limit(sample).select(F.col(vector_col).cast("array<double>").alias("v")).collect()
    if not asked:
        return 0.0
    asked = np.array([r["v"] for r in asked], dtype=np.float64)
    spark = indexed.sparkSession
    queries = spark.createDataFrame(
        [(k, v.tolist()) for k, v in enumerate(asked)], "query_id bigint, query_vector array<double>"
    )
    short = indexed.select(id_col, "cell", vector_col)
    found = search_many(short, queries, limit, float("-inf"), metric, id_col, vector_col)
    far = np.sqrt(_distances(np.asarray(centres, dtype=np.float64), asked, "l2").T)
    extra = [far[r["query_id"], r["cell"]] - far[r["query_id"]].min() for r in
             found.select("query_id", "cell").collect()]
    extra = np.sort(extra)
    return float(extra[math.ceil(share * len(extra)) - 1]) if len(extra) else 0.0


def search_cells(
    indexed: DataFrame,
    centres: np.ndarray,
    queries: DataFrame,
    probes: int = 8,
    limit: int = SEARCH_LIMIT,
    min_score: float = 0.0,
    metric: str = "l2",
    id_col: str = "id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    reach: float = 0.0,
) -> DataFrame:
    """Approximate search: only the cells nearest to a query, exact inside them.

    A query probes its ``probes`` nearest cells, those within ``reach`` of the nearest, which
    ``measured_reach`` gives, and as many as hold ``limit`` rows. Only the sizes of cells, of which
    there are as many as centres, reach the driver. Blocks are counted per cell, so a query is sent to the blocks of its
    cells and to no others.
    """
    asked = _queries(queries, query_id, query_vector).filter(F.col("query_vector").isNotNull())
    indexed = indexed.withColumn("__cell", F.col("cell").cast("int")).drop("cell")
    sizes = np.zeros(len(centres))
    usable = indexed.filter(F.col(vector_col).isNotNull())
    for row in usable.groupBy("__cell").count().collect():
        sizes[row["__cell"]] = row["count"]
    cells = nearest_cells(F.col("query_vector"), centres, probes, reach, sizes, limit)
    asked = asked.withColumn("__cell", F.explode(cells))
    found = _met(indexed, asked, id_col, vector_col, limit, metric)
    return _finish(found, id_col, limit, metric, min_score)
