"""Exact nearest vectors, compared in squares of bounded size.

A square is SIDE vectors by QUERIES queries at most, dealt to tasks by a shuffle. Within a square a matrix
product says which pairs can be among the k nearest, with slack for its rounding; only these are compared
as SQL does (term by term, in order, in double precision), rounded, and cut to k a query. So a task holds
one square, nothing is broadcast or collected, and a square gives k rows a query at most; the
number of squares does grow with vectors times queries.

Of equal vectors of a square the k with the least keys are compared: the others tie with them everywhere.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors and queries of a square, at most (about, as they are dealt by hashes), and pairs of a product.
SIDE, QUERIES, PAIRS = 8192, 2048, 1 << 20


def usable(vector: Column, size: int) -> Column:
    """Whether a vector can be compared with others of a size."""
    return F.coalesce(F.size(vector) == size, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one size, without nulls, as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1 if len(whole) else 0)


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Half up by the decimal digits, as round() of SQL."""
    scaled = x * 10.0**decimals
    out = np.floor(scaled + 0.5) / 10.0**decimals
    with np.errstate(invalid="ignore"):
        close = np.isfinite(x) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + 1e-12 * np.abs(scaled))
    unit = Decimal(1).scaleb(-decimals)
    for i in np.nonzero(close)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x)


def _least_of_equal(x: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors that stay: the k least keys of equal ones, by key."""
    order = np.argsort(keys, kind="stable")
    rows = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel() if x.shape[1] else np.zeros(len(x), np.int8)
    _, group, sizes = np.unique(rows, return_inverse=True, return_counts=True)
    if sizes.max(initial=0) <= k:
        return order
    by_group = np.argsort(group, kind="stable")
    nth = np.empty(len(rows), np.int64)
    nth[by_group] = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[nth < k]


def nearest_of(x: np.ndarray, keys: np.ndarray, q: np.ndarray, bounds: np.ndarray | None, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of vectors and rounded squared distances: the k nearest of each query (ties by key),
    of those not beyond its bound."""
    stay = _least_of_equal(x, keys, k)
    x = x[stay]  # by key, so that the place of a vector decides ties
    finite = bool(np.isfinite(x).all() and np.isfinite(q).all())
    with np.errstate(all="ignore"):
        norms, tops = (x**2).sum(1), (q**2).sum(1)
    slack = 1e-9 * (tops + norms.max(initial=0)) + 2 * 10.0**-decimals
    found: list[tuple] = []
    step = max(1, PAIRS // max(1, len(x)))
    for at in range(0, len(q), step) if len(x) else ():
        part = slice(at, at + step)
        with np.errstate(all="ignore"):
            far = tops[part, None] + norms - 2 * (q[part] @ x.T)
            if not finite:
                far[~np.isfinite(far)] = np.inf
            limit = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(far), np.inf)
            if bounds is not None:
                limit = np.minimum(limit, bounds[part])
            i, j = np.nonzero(far <= (limit + (slack[part] if finite else np.nan_to_num(slack[part], nan=np.inf)))[:, None])
            exact = np.zeros(len(i))
            for d in range(x.shape[1]):
                gap = x[j, d] - q[at + i, d]
                exact += gap * gap
        exact = rounded(exact, decimals)
        order = np.lexsort((j, exact, i))
        first = np.searchsorted(i[order], np.arange(len(far)))
        order = order[np.arange(len(order)) - first[i[order]] < k]
        found.append((at + i[order], stay[j[order]], exact[order]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def compared(vectors: DataFrame, queries: DataFrame, square: list[str], k: int, decimals: int, key: str, vector: str, query: str, asked: str, bound: str | None = None) -> DataFrame:
    """query, key, distance: the k nearest of each query in each square. Both sides have the columns ``square``; all
    vectors are usable() for one size."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column(key).combine_chunks()
        ranks = pc.rank(keys, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        bounds = right.column(bound).to_numpy() if bound else None
        if not (left.num_rows and right.num_rows):  # a hash may leave a side empty
            return pa.table([right.column(query)[:0].combine_chunks(), keys[:0], pa.array([], pa.float64())], [query, key, "distance"])
        i, j, far = nearest_of(matrix(left.column(vector)), ranks, matrix(right.column(asked)), bounds, k, decimals)
        return pa.table([right.column(query).combine_chunks().take(pa.array(i)), keys.take(pa.array(j)), pa.array(far)], [query, key, "distance"])

    kind = f"{query} {queries.schema[query].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
    return vectors.groupBy(*square).cogroup(queries.groupBy(*square)).applyInArrow(run, kind)
