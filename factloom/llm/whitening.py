"""Embedding whitening by a bidiagonal qd solver.

Tasks reduce blocks of centred rows to triangles by QR, triangles meet in groups of ``FAN`` until one
is left for each vector length. That triangle, as large as the vectors are long and no larger, is
solved on the driver: Householder reflections make it bidiagonal, dqds finds its singular values to
high relative accuracy, twisted factorisations give the directions. Rows are whitened in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

SCALE, OFFSET, MOST = 64, 1_000_000, 16
#: Parts that one task merges, and rows of a block.
FAN, BLOCK = 16, 4096
#: Scaled entries beyond this are no exact doubles any more.
LARGEST = 2**52
EPS = float(np.finfo(float).eps)


class Directions(NamedTuple):
    """Whitening for vectors of one length; ``vectors`` has a column for each component."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float = 0.0


# ---- the solver ------------------------------------------------------------------------------


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right reflections ``w``: ``square = u B w.T``."""
    work = np.array(square, dtype=float)
    size = len(work)
    right = np.eye(size)
    for k in range(size):
        mirror = _mirror(work[k:, k])
        work[k:, k:] -= 2 * np.outer(mirror, mirror @ work[k:, k:])
        if k + 2 < size:
            mirror = _mirror(work[k, k + 1 :])
            work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ mirror, mirror)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ mirror, mirror)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _mirror(column: np.ndarray) -> np.ndarray:
    """The unit normal of the reflection that turns ``column`` onto the first axis."""
    normal = column.copy()
    length = np.linalg.norm(column)
    if length == 0:
        return normal
    normal[0] += np.copysign(length, column[0])
    return normal / np.linalg.norm(normal)


def _below(q: list[float], e: list[float]) -> float:
    """The reciprocal of the summed reciprocal eigenvalues, so never above the least of them."""
    part, total = 0.0, 0.0
    for k, value in enumerate(q):
        part = (1.0 + (e[k - 1] * part if k else 0.0)) / value
        total += part
    return 1.0 / total


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list, list] | None:
    """One dqds step; None if the shift was beyond the least eigenvalue."""
    new_q, new_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for k, step in enumerate(e):
        if d < 0:
            return None
        new_q[k] = d + step
        ratio = q[k + 1] / new_q[k]
        new_e[k] = step * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Of an upper bidiagonal matrix, falling, by dqds with shifts that stay below."""
    scale = float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    # A diagonal entry of nothing would stop the recurrence; this one is far below rounding.
    q = [max(abs(float(a)) / scale, 1e-20) ** 2 for a in diagonal]
    e = [(float(b) / scale) ** 2 for b in above]
    found, parts = [], [(q, e, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while len(q) > 1:
            cut = next(
                (k for k in range(len(e) - 1, -1, -1) if e[k] <= (EPS * EPS) * (moved + q[k + 1])),
                None,
            )
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # Rounding can put the bound a trifle too high near the end.
            shift = _below(q, e) * (1 - 8 * EPS) if min(q) > 0 else 0.0
            step = _transformed(q, e, shift)
            while step is None:
                shift = 0.0 if shift < 1e-300 else shift * 0.5
                step = _transformed(q, e, shift)
            q, e = step
            q = [max(x, 1e-300) for x in q]
            moved += shift
        found.append(moved + q[0])
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(square: np.ndarray, lower: np.ndarray, value: float):
    """Multipliers from both ends of ``L D L' - value`` and the twist terms."""
    size = len(square)
    tiny = EPS * EPS * max(float(square.max()), 1e-300)
    down, up = np.zeros(size - 1), np.zeros(size - 1)
    s, p = np.zeros(size), np.zeros(size)
    s[0] = -value
    for k in range(size - 1):
        pivot = square[k] + s[k] or tiny
        down[k] = square[k] * lower[k] / pivot
        s[k + 1] = down[k] * lower[k] * s[k] - value
    p[-1] = square[-1] - value
    for k in range(size - 2, -1, -1):
        pivot = square[k] * lower[k] ** 2 + p[k + 1] or tiny
        ratio = square[k] / pivot
        up[k] = lower[k] * ratio
        p[k] = p[k + 1] * ratio - value
    return down, up, s + p + value


def _vector(down: np.ndarray, up: np.ndarray, twist: int) -> np.ndarray:
    out = np.zeros(len(down) + 1)
    out[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        out[k] = -down[k] * out[k + 1]
    for k in range(twist, len(down)):
        out[k + 1] = -up[k] * out[k]
    return out / np.linalg.norm(out)


def _directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix for the falling singular ``values``.

    Values closer than a thousandth take their vectors at different twists and are made orthogonal.
    Should no twist give a new direction, inverse iteration does.
    """
    scale = values[0]
    a = diagonal / scale
    a = np.where(np.abs(a) < 1e-20, 1e-20, a)
    square, lower = a**2, above / scale / a[:-1]
    size = len(a)
    dense = np.diag(a) + np.diag(above / scale, 1)
    dense = dense.T @ dense
    rng = np.random.default_rng(13)
    out: list[np.ndarray] = []
    for k, sigma in enumerate(values):
        value = float(sigma / scale) ** 2
        near = [out[j] for j in range(k) if values[j] ** 2 - sigma**2 <= 1e-3 * values[j] ** 2]

        def apart(vector, near=near):
            for _ in range(2):
                for other in near:
                    vector = vector - other * (other @ vector)
            return vector

        chosen = None
        with np.errstate(all="ignore"):
            down, up, twist = _twisted(square, lower, value)
            for r in np.argsort(np.abs(twist))[: len(near) + 1]:
                vector = apart(_vector(down, up, int(r)))
                if np.isfinite(vector).all() and np.linalg.norm(vector) > 0.5:
                    vector = vector / np.linalg.norm(vector)
                    if np.linalg.norm(dense @ vector - value * vector) < 1e-11:
                        chosen = vector
                        break
        if chosen is None:
            chosen = apart(rng.standard_normal(size))
            moved = dense - (value * (1 + 4 * EPS) + EPS) * np.eye(size)
            for _ in range(3):
                chosen = apart(np.linalg.solve(moved, chosen / np.linalg.norm(chosen)))
            chosen = chosen / np.linalg.norm(chosen)
        out.append(chosen)
    return np.array(out).reshape(len(out), size).T


def solved(triangle: np.ndarray, n: int, sums: np.ndarray, most: int = MOST) -> Directions:
    """The leading directions of ``n`` centred rows whose QR triangle this is.

    Directions without variance, up to rounding, cannot be whitened and are left out.
    """
    diagonal, above, right = bidiagonal(triangle)
    sigma = singular_values(diagonal, above)
    total = float((triangle**2).sum())
    sigma = sigma[:most][sigma[:most] > max(len(sigma), 16) * EPS * (sigma[0] if len(sigma) else 0)]
    if not len(sigma) or total == 0:
        none = np.zeros(0)
        return Directions(n, sums, none, np.zeros((len(sums), 0)), none)
    vectors = right @ _directions(diagonal, above, sigma)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sigma))])
    return Directions(n, sums, sigma**2 / n, vectors, sigma**2 / total)


# ---- blocks of rows --------------------------------------------------------------------------


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of all vectors of one length, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size:
            yield at, flat[starts[at][:, None] + np.arange(size)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``, subtracted as whole numbers where they fit."""
    if n * float(np.abs(x).max(initial=0)) < 2.0**61:
        return (n * x - sums) / n
    return x - sums / n


def _whitened(x: np.ndarray, by: Directions) -> np.ndarray:
    return _centred(x, by.n, by.sums) @ (by.vectors / np.sqrt(by.values))


def _deviation(x: np.ndarray, by: Directions) -> np.ndarray:
    """Exact sums of squares of ``n * x - sums``; null where a long does not hold them."""
    rough = (_centred(x, by.n, by.sums) ** 2).sum(axis=1) * float(by.n) ** 2
    fits = rough < 2.0**62
    exact = np.zeros(len(x), dtype=np.int64)
    exact[fits] = ((by.n * x[fits] - by.sums) ** 2).sum(axis=1)
    return np.ma.MaskedArray(exact, ~fits)


_PART = "length int, slot long, part array<double>"


def _parts(rows: DataFrame, start: Callable, add: Callable) -> DataFrame:
    """For each task and vector length, what ``add`` makes of all blocks, as flat numbers."""

    def run(batches):
        held = {}
        for batch in batches:
            for _, block in _matrices(batch.column(0)):
                size = block.shape[1]
                for k in range(0, len(block), BLOCK):
                    before = held[size] if size in held else start(size)
                    if before is not None:
                        held[size] = add(before, block[k : k + BLOCK], size)
        slot = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "length": pa.array(list(held), pa.int32()),
                "slot": pa.array([slot] * len(held), pa.int64()),
                "part": pa.array([p.ravel() for p in held.values()], pa.list_(pa.float64())),
            }
        )

    return rows.mapInArrow(run, _PART)


def _merged(parts: DataFrame, merge: Callable, label: str) -> dict[int, np.ndarray]:
    """One part for each vector length, merged by ``FAN`` in as many rounds as that takes."""

    def join(table: pa.Table) -> pa.Table:
        size = table["length"][0].as_py()
        blocks = [np.asarray(p, dtype=float) for p in table["part"].to_pylist()]
        return pa.table(
            {
                "length": table["length"][:1],
                "slot": pa.array([table["slot"][0].as_py() // FAN], pa.int64()),
                "part": pa.array([merge(blocks, size).ravel()], pa.list_(pa.float64())),
            }
        )

    while True:
        parts = cut_lineage(parts, label)
        most = parts.agg(F.max("slot")).first()[0]
        if most is None:
            return {}
        grouped = parts.groupBy("length", F.expr(f"slot div {FAN}").alias("group"))
        if most < FAN:
            found = grouped.applyInArrow(lambda _, table: join(table), _PART).toArrow()
            return {
                size: np.asarray(part, dtype=float)
                for size, part in zip(
                    found["length"].to_pylist(), found["part"].to_pylist(), strict=True
                )
            }
        parts = grouped.applyInArrow(lambda _, table: join(table), _PART)


def _triangle(blocks: list[np.ndarray], size: int) -> np.ndarray:
    stacked = np.vstack([b.reshape(-1, size) for b in blocks])
    if len(stacked) < size:
        stacked = np.vstack([stacked, np.zeros((size - len(stacked), size))])
    return np.linalg.qr(stacked, mode="r")


def _moments(blocks: list[np.ndarray], size: int) -> np.ndarray:
    """Counts, means and centred products of two or more sets of rows as those of their union."""
    count, mean, products = 0.0, 0.0, 0.0
    for flat in blocks:
        k = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
        n, m, p = flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)
        if n == 0:
            continue
        apart = m - mean
        products = products + p + np.outer(apart, apart) * (count * n / (count + n))
        mean = mean + apart * (n / (count + n))
        count += n
    return np.concatenate([[count], mean, np.ravel(products)])


# ---- tables ----------------------------------------------------------------------------------


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: usable vectors, entries as ``floor(64 * c)`` (the offset moves nothing)."""
    c = F.col(vector).cast("array<double>")
    usable = F.forall(c, lambda x: x.isNotNull() & (F.abs(x * SCALE) < LARGEST))
    x = F.transform(c, lambda x: F.floor(x * SCALE).cast("long"))
    return rows.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).alias("key"), x.alias("x"))


def fitted(x: DataFrame, most: int = MOST) -> dict[int, Directions]:
    """Directions for each vector length of ``x``, over each distinct vector once."""
    fit = cut_lineage(x.select("x").distinct(), "fit")
    at = F.posexplode("x").alias("at", "c")
    sums = fit.select(F.size("x").alias("length"), at).groupBy("length", "at")
    totals: dict[int, list] = {}
    for r in sums.agg(F.count("*").alias("n"), F.sum("c").alias("s")).orderBy("length", "at").collect():
        totals.setdefault(r["length"], []).append((r["n"], r["s"]))
    known = {k: (v[0][0], np.array([s for _, s in v], dtype=np.int64)) for k, v in totals.items()}

    def add(before, block, size):
        return _triangle([before, _centred(block, *known[size])], size)

    parts = _parts(fit, lambda size: np.zeros((0, size)), add)
    found = {
        size: solved(flat.reshape(size, size), *known[size], most)
        for size, flat in _merged(parts, _triangle, "triangles").items()
    }

    def empty(size):
        k = len(found[size].values)
        return np.zeros(1 + k + k * k) if k else None

    def measure(before, block, size):
        white = _whitened(block, found[size])
        mean = white.mean(axis=0)
        products = (white - mean).T @ (white - mean)
        return _moments([before, np.concatenate([[len(white)], mean, products.ravel()])], size)

    errors = {}
    for size, flat in _merged(_parts(fit, empty, measure), _moments, "moments").items():
        k = len(found[size].values)
        products = flat[k + 1 :].reshape(k, k) / flat[0]
        errors[size] = float(np.abs(products - np.eye(k)).max())
    return {size: by._replace(error=errors.get(size, 0.0)) for size, by in found.items()}


def whitened(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``.

    One row for each usable vector and component. Null vectors and those with null, infinite, NaN or
    unscalable entries take no part; vectors of each length are fitted for themselves. A length whose
    vectors do not vary, and a component without variance, give no rows, as does an empty table.
    Repeated vectors count once in the fit and are all whitened; null keys stay null. Other columns
    are not looked at. ``deviation`` is null where a long does not hold it.
    """
    x = integer_vectors(rows, key, vector)
    directions = fitted(x, most)

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for at, block in _matrices(batch.column(1)):
                by = directions.get(block.shape[1])
                k = len(by.values) if by else 0
                if not k:
                    continue
                white, off = _whitened(block, by), _deviation(block, by)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, by.n)),
                        pa.array(np.repeat(off.data, k), mask=np.repeat(np.ma.getmaskarray(off), k)),
                        pa.array(white.ravel()),
                        pa.array(np.tile(by.explained, len(at))),
                        pa.array(np.full(len(at) * k, by.error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = x.schema["key"].dataType.simpleString()
    out = x.mapInArrow(
        run,
        f"key {kind}, component int, n long, deviation long, whitened double, explained double,"
        " identity_error double",
    )
    return out.withColumnRenamed("key", key)
