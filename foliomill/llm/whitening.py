"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never built. A block of directions Q goes to the vectors, each task multiplies its centred
vectors X as Xᵀ(XQ), and only those sums come back. A Chebyshev polynomial of the covariance, evaluated by its
three-term recurrence with one such pass a degree, damps all of the spectrum below the block; QR and Rayleigh-Ritz
give the next block, until the residuals of the wanted components certify them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.words import written

SCALE = 256
BLOCK_BYTES = 1 << 20
DEGREE = 10
TOLERANCE = 1e-13
LONGEST = (1 << 63) - 1


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), dimension)


def _blocks(distinct: DataFrame, dimension: int) -> DataFrame:
    """``(n, wide, data)``: the vectors as matrices of at most ``BLOCK_BYTES``, of 2 or 8 bytes an entry."""
    rows = max(1, BLOCK_BYTES // (8 * dimension))

    def task(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            for at in range(0, len(x), rows):
                part = x[at:at + rows]
                wide = bool(len(part)) and not -(1 << 15) <= part.min() <= part.max() < 1 << 15
                data = np.ascontiguousarray(part, np.int64 if wide else np.int16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([wide]), pa.array([data], pa.binary())], ["n", "wide", "data"])

    return distinct.mapInArrow(task, "n int, wide boolean, data binary")


def _unpacked(batch: pa.RecordBatch, dimension: int):
    for wide, data in zip(batch.column("wide").to_pylist(), batch.column("data")):
        yield np.frombuffer(data.as_buffer(), np.int64 if wide else np.int16).reshape(-1, dimension)


def _totals(blocks: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums per dimension. Halves of the entries are summed, so no sum overflows."""
    def task(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            for x in _unpacked(batch, dimension):
                x = x.astype(np.int64)
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        places = np.arange(dimension, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.full(dimension, n)), pa.array(high), pa.array(low)], ["place", "n", "high", "low"])

    sums = blocks.mapInArrow(task, "place int, n bigint, high bigint, low bigint").groupBy("place").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    rows = sorted(sums.collect())
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def _sums(blocks: DataFrame, dimension: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``of(centred block)``, a matrix of ``shape``, over all blocks: one row per task and matrix row, summed by Spark."""
    def task(batches):
        total = np.zeros(shape)
        for batch in batches:
            for x in _unpacked(batch, dimension):
                total += of(x - mean)
        values = pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1, dtype=np.int32) * shape[1]), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), values], ["place", "v"])

    rows = blocks.mapInArrow(task, "place int, v array<double>")
    summed = rows.groupBy("place").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(shape[1])]).alias("v")).collect()
    return np.array([r.v for r in sorted(summed)])


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of a matrix with spectrum in [0, top], bounded on [0, cut], times ``q``.

    ``apply`` multiplies by the matrix, ``vq`` is the first product.
    """
    half = cut / 2
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, degree: int = DEGREE, tolerance: float = TOLERANCE,
            seed: int = 0, max_rounds: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, vectors, residual)``: the ``wanted`` largest eigenvalues of a positive semidefinite matrix, falling.

    Certified: the residual of each, relative to the largest value, is at most ``tolerance``, or no longer falls
    because the passes' own rounding is reached (below 1e-11). A block that does not get there within ``max_rounds``
    (a spectrum without a gap) is doubled; one as wide as the matrix gives all of the spectrum without a filter.
    """
    rng = np.random.default_rng(seed)
    width = min(dimension, wanted + 28)
    q = np.linalg.qr(rng.standard_normal((dimension, width)))[0]
    while True:
        last = np.inf
        for _ in range(max_rounds):
            vq = apply(q)
            small = q.T @ vq
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            q, vq = q @ turn, vq @ turn
            if values[0] <= 0:
                return np.zeros(wanted), q[:, :wanted], 0.0
            error = float(np.max(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)) / values[0])
            if error <= tolerance or (error < 1e-11 and error > last / 4) or width == dimension:
                return values[:wanted], q[:, :wanted], error
            last = error
            cut = float(min(max(values[-1], 1e-3 * values[0]), 0.999 * values[0]))
            q = np.linalg.qr(chebyshev(apply, q, vq, degree, cut, float(values[0])))[0]
        more = min(dimension, 2 * width) - width
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((dimension, more))]))[0]
        width += more


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of ``(n * x - S) ** 2`` of each row, exactly; NULL where it is no long."""
    reach = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    bound = n * reach + max(map(abs, sums))
    if x.shape[1] * bound ** 2 <= LONGEST:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONGEST else None for v in exact]


def _projected(x: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """``x @ onto`` with one order of summing for all rows: a matrix product rounds by a row's place in its batch, so equal vectors would differ."""
    out = np.zeros((len(x), onto.shape[1]))
    for column, weights in zip(x.T, onto):
        out += column[:, None] * weights
    return out


def usable(column: str = "embedding"):
    """Not NULL, and without NULL or non-finite entries."""
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def _whitened(vectors: DataFrame, dimension: int, wanted: int) -> DataFrame:
    blocks = written(_blocks(vectors.select("x").distinct(), dimension), "whitening-blocks")
    n, sums = _totals(blocks, dimension)
    mean = np.array([s / n for s in sums])
    trace = float(_sums(blocks, dimension, mean, lambda x: np.array([[np.vdot(x, x)]]), (1, 1))[0, 0]) / n
    passes = lambda q: _sums(blocks, dimension, mean, lambda x: x.T @ (x @ q), q.shape) / n
    values, components, _ = leading(passes, dimension, min(wanted, dimension))
    # A direction without variance cannot be brought to variance 1.
    real = values > max(trace, 0.0) * dimension * 1e-14
    values, components = values[real], components[:, real]
    k = len(values)
    if not k:
        return None
    scaled = components / np.sqrt(values)
    of_white = _sums(blocks, dimension, mean, lambda x: (x @ scaled).T @ (x @ scaled), (k, k)) / n
    identity_error = float(np.max(np.abs(of_white - np.eye(k))))
    explained = (values / trace).tolist()

    def task(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            white = _projected(x - mean, scaled)
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                                              pa.array(np.full(len(x) * k, n)), deviation, pa.array(white.ravel()),
                                              pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, identity_error))], names)

    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = ["int", "bigint", "bigint", "double", "double", "double"]
    schema = vectors.select("id", *[F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], kinds)]).schema
    return vectors.mapInArrow(task, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", wanted: int = 4) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``: each vector on the first components, scaled to variance 1.

    Entries count as ``floor(256 * c)``; one beyond a long is the nearest long. The fit takes each distinct vector once: ``n`` of them,
    with sums S. ``deviation`` is the sum of ``(n * x - S) ** 2``, NULL if that is no long. ``explained`` is a component's
    share of the variance, ``identity_error`` the largest entry of the whitened covariance minus the identity, measured over the fit list.

    NULL vectors and those with NULL or non-finite entries are left out. Vectors of each length are whitened among themselves.
    A component without variance has no rows: equal vectors, a single one and vectors of length 0 have none. Repeated rows give repeated
    results; ties of eigenvalues take any of the directions, the same for all rows. Other columns are not looked at.
    The driver holds matrices of the dimension by the block (at most its square) and nothing that grows with the rows.
    """
    if id_col in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        raise ValueError(f"{id_col} is a column of the result: pass the id under another name")
    x = F.transform(column, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    rows = vectors.where(usable(column)).select(F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)
    # One row per length; in most tables there is one.
    lengths = sorted(r.d for r in rows.groupBy(F.size("x").alias("d")).count().collect())
    parts = [p for d in lengths if (p := _whitened(rows.where(F.size("x") == d), d, wanted)) is not None]
    empty = rows.select("id", F.lit(0).alias("component"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "deviation")],
                        *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).limit(0)
    out = empty
    for part in parts:
        out = part if out is empty else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
