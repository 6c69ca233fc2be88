"""Two tables meet in a grid of blocks: every row of one with every row of the other, by bounded groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of the searched table and of the queries, at most about.
ROW_BLOCK, QUERY_BLOCK = 65_536, 4_096


def usable(vector: str | Column) -> Column:
    """True for a vector with at least one component and without null, NaN or infinite ones."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & finite, F.lit(False))


def meet(
    queries: DataFrame,
    rows: DataFrame,
    by: str,
    query_id: str,
    row_id: str,
    search: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """What ``search`` gives for each pair of a block of ``queries`` and a block of ``rows`` that agree in ``by``.

    Rows are dealt by a hash of their id, which must not repeat, so that no block depends on what the rows hold. The
    numbers of blocks follow from the numbers of rows (and there are at least as many as tasks run at once); a row is
    sent once for each block of the other side. No result may depend on how rows are dealt.
    """
    n_rows, n_queries = rows.count(), queries.count()
    r = max(-(-n_rows // row_block), min(queries.sparkSession.sparkContext.defaultParallelism, max(1, n_rows // 256)))
    q = max(1, -(-n_queries // query_block))

    queries = queries.toDF(*queries.columns)  # columns of their own, where both sides come from one table

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own)
        return df.select("*", number, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    grid = [by, "_r", "_q"]
    left = dealt(queries, query_id, "_q", q, "_r", r).groupBy(*grid)
    right = dealt(rows, row_id, "_r", r, "_q", q).groupBy(*grid)
    return left.cogroup(right).applyInArrow(search, schema)


def matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], flat.type)
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(n, -1) if n else np.zeros((0, 0), dtype)


def first_by_score(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first entries of each group: largest score first, ties by the smaller id."""
    order = np.lexsort((ident, -score, group))
    sorted_group = group[order]
    starts = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - first < k]
