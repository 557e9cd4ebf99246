"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every pair of blocks is a tile. A tile rounds its
vectors to int8 with a scale of their own, multiplies the two matrices and gets all its distances
with a bound on their error: rounding moves a vector by a known length, and by the triangle
inequality a distance by at most the sum of two such lengths. Pairs that the bounds can't rule out
are computed again from the original vectors in double precision. A heap per query keeps a tile's
best, and the sorted lists of all tiles are merged by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
ROWS_AT_ONCE = 128
PAIRS_AT_ONCE = 1 << 16

BLOCKS = "dim bigint, block bigint, ids binary, vectors binary"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (doubles): rows with an id and a vector that is finite, whole and not all zero.

    Of rows that repeat an id, the one with the least vector stays.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"),
                          F.col(vector_column).cast("array<double>").alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & whole
                      & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def blocks(rows: DataFrame, per_block: int, most_equal: int | None = None) -> DataFrame:
    """Rows of (id, v) packed into matrices of about ``per_block`` rows of one dimension.

    Of equal vectors in a block only the ``most_equal`` least ids can be among the nearest of any
    query, so the others stay out of the matrix.
    """
    number = max(1, -(-rows.count() // per_block))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        n = len(ids)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(n, -1)
        if most_equal is not None:
            seen: dict[bytes, int] = {}
            keep = np.zeros(n, dtype=bool)
            for i, row in enumerate(matrix):
                key = row.tobytes()
                seen[key] = seen.get(key, 0) + 1
                keep[i] = seen[key] <= most_equal
            ids, matrix = ids[keep], matrix[keep]
        return pa.table({"dim": [matrix.shape[1]], "block": [table.column("block")[0].as_py()],
                         "ids": [ids.astype("<i8").tobytes()],
                         "vectors": [np.ascontiguousarray(matrix, "<f8").tobytes()]},
                        schema=pa.schema([("dim", pa.int64()), ("block", pa.int64()),
                                          ("ids", pa.binary()), ("vectors", pa.binary())]))

    dealt = rows.select("id", "v", F.size("v").cast("long").alias("dim"),
                        F.pmod(F.xxhash64("id"), F.lit(number)).alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, BLOCKS)


def int8_rows(matrix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rounded rows, their scales, their lengths and how far rounding moved each row."""
    scale = np.abs(matrix).max(axis=1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    rounded = np.rint(matrix / scale[:, None]).astype(np.int8)
    back = rounded * scale[:, None]
    return (rounded, scale, np.sqrt((back ** 2).sum(axis=1)),
            np.sqrt(((matrix - back) ** 2).sum(axis=1)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares would leave the range of doubles, of rows scaled."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        off = a - b
        out = np.sqrt((off ** 2).sum(axis=1))
        most = np.abs(off).max(axis=1)
        odd = np.flatnonzero(~(most < 1e150) | ((most < 1e-150) & (most > 0)))
        if len(odd):
            half = a[odd] / 2 - b[odd] / 2
            size = np.abs(half).max(axis=1)
            half /= size[:, None]
            out[odd] = np.sqrt((half ** 2).sum(axis=1)) * size * 2
    return out


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
                 k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """(query id, its at most k best (distance, id)) of one tile, exact; own ids left out.

    Vectors so large or small that bounds overflow or vanish are computed again, all of them.
    """
    # products of int8 stay whole numbers in floats of enough bits, and those multiply fast
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    q8, q_scale, q_len, q_off = int8_rows(q)
    c8, c_scale, c_len, c_off = int8_rows(c)
    right = c8.astype(kind).T
    out = []
    for i in range(0, len(q), ROWS_AT_ONCE):
        rows = slice(i, i + ROWS_AT_ONCE)
        product = (q8[rows].astype(kind) @ right).astype(np.float64)
        product *= -2 * q_scale[rows, None] * c_scale
        product += q_len[rows, None] ** 2 + c_len ** 2
        near = np.sqrt(np.maximum(product, 0, out=product), out=product)
        slack = q_off[rows, None] + c_off + 1e-6 * (q_len[rows, None] + c_len)
        own = q_ids[rows, None] == c_ids
        near[~np.isfinite(near)] = np.nan
        upper = near + slack
        upper[own] = np.nan
        limit = (np.partition(upper, k - 1, axis=1)[:, k - 1] if len(c) > k
                 else np.full(len(upper), np.inf))
        # without a bound (NaN) a pair is not ruled out
        left = ~(near - slack > limit[:, None]) & ~own
        at_q, at_c = np.nonzero(left)
        exact = np.empty(len(at_q))
        for j in range(0, len(at_q), PAIRS_AT_ONCE):
            part = slice(j, j + PAIRS_AT_ONCE)
            exact[part] = distances(q[i + at_q[part]], c[at_c[part]])
        cuts = np.searchsorted(at_q, np.arange(len(near) + 1))
        names = c_ids[at_c]
        for r in range(len(near)):
            pairs = zip(exact[cuts[r]:cuts[r + 1]].tolist(), names[cuts[r]:cuts[r + 1]].tolist(),
                        strict=True)
            best = heapq.nsmallest(k, pairs)
            if best:
                out.append((int(q_ids[i + r]), best))
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding", block_rows: int = BLOCK_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest candidates of each query, exactly.

    Euclidean distance on the original vectors in double precision; ties go to the smaller id; a
    candidate of the query's own id is left out. Vectors that are null, empty, all zero or hold a
    null or non-finite number take no part, nor do rows without an id; vectors of other lengths
    than the query's are no candidates. A query without candidates gives no rows. Other columns
    are ignored. Query blocks, the smaller side, are copied to every candidate block.
    """
    known = usable(candidates, id_column, vector_column)
    rights = blocks(known, block_rows, k + 1)
    lefts = blocks(usable(queries, id_column, vector_column), query_rows)
    last = max(1, -(-known.count() // block_rows)) - 1
    lefts = lefts.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
                         F.explode(F.expr(f"sequence(0L, {last}L)")).alias("block"))
    tiles = lefts.join(rights, ["dim", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, c_ids = (np.frombuffer(row[x], "<i8") for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(row[x], "<f8").reshape(-1, row["dim"])
                        for x in ("q_vectors", "vectors"))
                found = tile_nearest(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([[s for s, _ in f[1]] for f in found], pa.list_(pa.float64())),
                     pa.array([[v for _, v in f[1]] for f in found], pa.list_(pa.int64()))],
                    names=["query_id", "scores", "ids"])

    def merge(table: pa.Table) -> pa.Table:
        lists = (zip(s, v, strict=True) for s, v in zip(
            table.column("scores").to_pylist(), table.column("ids").to_pylist(), strict=True))
        best = [pair for pair, _ in zip(heapq.merge(*lists), range(k))]
        n = len(best)
        return pa.table([pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()),
                         pa.array(range(1, n + 1), pa.int32()),
                         pa.array([v for _, v in best], pa.int64()),
                         pa.array([s for s, _ in best], pa.float64())],
                        names=["query_id", "rank", "vec_id", "score"])

    found = tiles.mapInArrow(search, "query_id bigint, scores array<double>, ids array<bigint>")
    return found.groupBy("query_id").applyInArrow(
        merge, "query_id bigint, rank int, vec_id bigint, score double")
