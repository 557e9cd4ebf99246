"""Whitening of embeddings: leading eigenvectors of the covariance by spectrum slicing.

Entries become whole numbers, so that sums and deviations are exact. The covariance of the distinct
vectors is summed from products of centred rows, a partial matrix per task; what reaches the driver
depends on the number of dimensions only. There Householder reflections make it tridiagonal. The
LDL^T decomposition of the shifted matrix has as many positive pivots as there are eigenvalues above
the shift; halving an interval by that count isolates each leading eigenvalue. Rayleigh quotient
iteration finds it within its interval, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded
from wavespan.session import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of larger size than this, after scaling, count as this.
MOST = float(1 << 52)
EPS = float(np.finfo(float).eps)


def integer_rows(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding"
                 ) -> DataFrame:
    """vec_id, dim, x: rows whose vector is not null and holds finite numbers only; x is binary,
    little-endian 64-bit floor(64 c) + 1,000,000."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                          F.col(vector_column).cast("array<double>").alias("v"))
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(v.isNotNull() & whole)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            entries = lists.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * entries), -MOST, MOST).astype(np.int64) + SHIFT
            data, bounds = x.astype("<i8").tobytes(), (bounds - bounds[0]) * 8
            cut = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds) // 8), pa.array(cut, pa.binary())],
                names=["vec_id", "dim", "x"])

    return bounded(rows).mapInArrow(convert, "vec_id bigint, dim bigint, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dim)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sums over all rows of a matrix of ``width`` columns that ``part`` makes of a batch.

    Each task adds up its batches; lines of the tasks' matrices are added by groups.
    """
    dim = rows.first()["dim"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_matrix(batch.column(0), dim))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["line", "entries"])

    lines = bounded(rows.select("x")).mapInArrow(add, "line bigint, entries array<double>")
    cells = lines.select("line", F.posexplode("entries").alias("at", "entry"))
    sums = cells.groupBy("line", "at").agg(F.sum("entry").alias("entry")).collect()
    out = np.zeros((1 + max((r["line"] for r in sums), default=-1), width))
    for r in sums:
        out[r["line"], r["at"]] = r["entry"]
    return out


def count_and_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of ``fit`` and the exact sum of each dimension."""
    high, low = 1 << 32, (1 << 32) - 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, dim), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            total += np.array([(x >> 32).sum(axis=0), (x & low).sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, n)), pa.array(range(dim), pa.int64()), pa.array(total[0]),
             pa.array(total[1])], names=["n", "at", "high", "low"])

    parts = bounded(fit.select("x")).mapInArrow(add, "n bigint, at bigint, high bigint, low bigint")
    rows = parts.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
                                     for c in ("n", "high", "low")]).orderBy("at").collect()
    return int(rows[0]["n"]), [int(r["high"]) * high + int(r["low"]) for r in rows]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they suffice, Python's otherwise."""
    most = n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def square_sums(d: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; None where a long can't hold one."""
    if d.dtype != object:
        most = max(abs(int(d.min())), abs(int(d.max())))
        if most * most * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
    found = (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in found]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix similar to symmetric ``a``, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        column = a[k + 1:, k]
        size = np.linalg.norm(column)
        if size == 0:
            continue
        v = column.copy()
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        q = p - (v @ p) * v
        block -= 2 * (np.outer(v, q) + np.outer(q, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, column[0])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL^T of the shifted matrix."""
    above, pivot = 0, 1.0
    for d, o in zip((diagonal - shift).tolist(), [0.0, *(off ** 2).tolist()], strict=True):
        pivot = d - o / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def rayleigh(v: np.ndarray, low: float, high: float, against: np.ndarray) -> tuple[float, np.ndarray]:
    """The eigenvalue of ``v`` in [low, high] and its unit vector, orthogonal to the columns of
    ``against``. The interval's middle starts as shift; the quotient takes over once it lies in it."""
    n = len(v)
    y = np.cos(np.arange(1, n + 1) ** 2.0)
    scale = np.linalg.norm(v)
    shift, value = (low + high) / 2, None
    best = (np.inf, shift, y)
    for _ in range(50):
        y = y - against @ (against.T @ y)
        y = y / np.linalg.norm(y)
        quotient = float(y @ v @ y)
        residual = np.linalg.norm(v @ y - quotient * y)
        inside = low <= quotient <= high
        if inside and residual < best[0]:
            best = (residual, quotient, y)
        elif inside and value is not None and residual <= 64 * EPS * scale:
            break
        value = quotient if inside else None
        shift = quotient if inside and residual <= high - low + 64 * EPS * scale else (low + high) / 2
        moved = shift
        for step in range(1, 9):
            try:
                y = np.linalg.solve(v - moved * np.eye(n), y)
                break
            except np.linalg.LinAlgError:   # the shift is an eigenvalue to the last bit
                moved = shift + step * EPS * scale
    return best[1], best[2]


def leading_eigenpairs(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of symmetric, positive semidefinite ``v`` in falling order and unit eigenvectors
    as columns; those not above 0 to working precision are left out.

    Each vector's entry of largest size is positive. Eigenvalues that can't be told apart to
    working precision get orthogonal vectors of their common space.
    """
    n = len(v)
    diagonal, off = tridiagonal(v)
    edge = float((np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max()) if n else 0
    if edge == 0:
        return np.zeros(0), np.zeros((n, 0))
    tiny, width = edge * EPS ** 2, 4 * n * EPS * edge
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(diagonal, off, shift, tiny)
        return counts[shift]

    values, vectors = [], np.zeros((n, 0))
    for k in range(1, min(most, above(n * EPS * edge)) + 1):
        low, high = 0.0, 2 * edge
        for shift, count in counts.items():     # what earlier counts tell
            if count >= k:
                low = max(low, shift)
            else:
                high = min(high, shift)
        # other eigenvalues at least an interval's length away: the middle's nearest is the one in it
        while high - low > width and not (above(2 * low - high) == k and above(2 * high - low) == k - 1):
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        value, vector = rayleigh(v, low, high, vectors)
        if not (above(value - width) >= k > above(value + width)):
            raise ArithmeticError(f"counts do not certify eigenvalue {k}")
        vector = vector * np.sign(vector[np.argmax(np.abs(vector))])
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _whiten(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """The rows of one dimension, whitened by their own covariance."""
    fit = stored(rows.select("dim", "x").distinct())
    n, sums = count_and_sums(fit, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return (deviations(x, n, sums) / n).astype(float)

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    covariance = _summed(fit, products, dim) / n
    values, vectors = leading_eigenpairs((covariance + covariance.T) / 2, most)
    k = len(values)
    turn = vectors / np.sqrt(values)

    def white_products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = 0.0
    if k:
        found = _summed(fit, white_products, k) / n
        error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / np.trace(covariance) if k else values
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = deviations(_matrix(batch.column(1), dim), n, sums)
            rows_in, size = len(d), len(d) * k
            at = pa.array(np.repeat(np.arange(rows_in), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)),
                 pa.array(np.full(size, n)), pa.array(square_sums(d), pa.int64()).take(at),
                 pa.array(((d / n).astype(float) @ turn).ravel()), pa.array(np.tile(explained, rows_in)),
                 pa.array(np.full(size, error))], names=names)

    return bounded(rows.select("vec_id", "x")).mapInArrow(
        project, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                 "explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and leading
    component.

    Rows whose vector is null or holds null or non-finite entries are left out; rows without an id
    or with repeated ids are kept, each for itself. The covariance is that of the distinct integer
    vectors. Components without spread (eigenvalue 0, as for a single distinct vector or an empty
    one) have no whitened form and are left out. Vectors of different lengths are whitened apart,
    each length by its own covariance. A deviation beyond a long is null; entries beyond 2^52 / 64
    count as that. Other columns are ignored.
    """
    rows = stored(integer_rows(vectors, id_column, vector_column))
    lengths = sorted(r["dim"] for r in rows.select("dim").where("dim > 0").distinct().collect())
    out = None
    for dim in lengths:
        part = _whiten(rows.where(F.col("dim") == dim), dim, components)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                "explained double, identity_error double")
    return out
