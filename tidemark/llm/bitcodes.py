"""Nearest neighbours by largest inner product, with one-bit codes of randomly rotated vectors.

A vector is taken relative to the mean, scaled to unit length, padded and rotated at random; the signs are its code. With
the length, and the inner product of the unit vector with its code, the code gives an unbiased estimate of the inner
product with any query, whose error has a known spread. A query is rotated as well and rounded to a few bits, so
that estimates come from counts of common bits. A row whose estimate plus ``ERRORS`` standard errors reaches
the k-th best score of the query so far is scored exactly; others cannot be among the nearest, up to the chance that an error
exceeds the bound.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import grid
from tidemark.llm.common import map_rows, written

K = 20
#: Bits of a code for each component (the padding), bits of a rounded query component, standard errors of the bound.
CODE_BITS, QUERY_BITS, ERRORS = 4, 4, 3.0
SEED = 7
#: Queries and rows whose estimates a task holds at once.
_QUERIES, _ROWS = 64, 2048
#: Times k rows by estimate that are scored before the bar is set.
_LEADS = 4


def code_length(dims: int) -> int:
    """Bits of a code: ``CODE_BITS`` for each component, in whole words of 64."""
    return -(-CODE_BITS * dims // 64) * 64


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """The first ``dims`` rows of a random rotation: padding with zeros and rotating, in one."""
    normal = np.random.default_rng([SEED, dims]).standard_normal((code_length(dims), dims))
    q, r = np.linalg.qr(normal)
    return (q * np.sign(np.diag(r))).T


def encode(vectors: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (words of 64 bits), lengths relative to the center, and inner products of unit vectors with their codes."""
    relative = vectors - center
    length = np.linalg.norm(relative, axis=1)
    turned = (relative / np.where(length > 0, length, 1)[:, None]) @ rotation(vectors.shape[1])
    codes = np.packbits(turned > 0, axis=1).view(np.uint64)
    fit = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    return codes, length, np.where(length > 0, fit, 1.0)


class Queries:
    """Rotated queries, rounded to ``QUERY_BITS`` bits and laid out as planes of bits."""

    def __init__(self, vectors: np.ndarray, center: np.ndarray):
        turned = vectors @ rotation(vectors.shape[1])
        self.bits = turned.shape[1]
        self.offset = vectors @ center
        self.norm = np.linalg.norm(vectors, axis=1)
        self.low = turned.min(1)
        span = turned.max(1) - self.low
        self.step = np.where(span > 0, span, 1) / (2**QUERY_BITS - 1)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = np.stack([np.packbits((whole >> j) & 1, axis=1).view(np.uint64) for j in range(QUERY_BITS)])
        self.sum = turned.sum(1)

    def estimate(self, part: slice, codes: np.ndarray, length: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of some queries with coded rows, and their standard errors."""
        planes = self.planes[:, part]
        common = np.zeros((planes.shape[1], len(codes)), np.float64)
        for w in range(codes.shape[1]):
            for j in range(QUERY_BITS):
                common += np.bitwise_count(planes[j, :, w, None] & codes[None, :, w]) * float(1 << j)
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        low, step, total = (x[part, None] for x in (self.low, self.step, self.sum))
        with_code = (2 * (low * ones + step * common) - total) / math.sqrt(self.bits)
        estimate = self.offset[part, None] + length * with_code / fit
        spread = (1 - np.minimum(fit, 1) ** 2) / max(1, self.bits - 1) * self.norm[part, None] ** 2 + step**2 / 6
        return estimate, length / fit * np.sqrt(spread)


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    codes: np.ndarray, length: np.ndarray, fit: np.ndarray, center: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, id, score) of the ``k`` best of the rows for each query, and how many rows were scored exactly."""
    prepared = Queries(queries, center)
    found, scored = [], 0
    for a in range(0, len(queries), _QUERIES):
        part = slice(a, min(a + _QUERIES, len(queries)))
        n = part.stop - a
        row, score, ident = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        limit = np.full(n, -np.inf)
        for b in range(0, len(ids), _ROWS):
            some = slice(b, b + _ROWS)
            about, error = prepared.estimate(part, codes[some], length[some], fit[some])
            most = about + ERRORS * error
            most[ids[some][None, :] == query_ids[part, None]] = -np.inf
            # The best by estimate first: their exact scores raise the bar for all others.
            lead = np.zeros(most.shape, bool)
            if most.shape[1] > _LEADS * k:
                np.put_along_axis(lead, np.argpartition(about, -_LEADS * k, axis=1)[:, -_LEADS * k :], True, axis=1)
            for chosen in (lead, ~lead):
                r, c = np.nonzero(chosen & (most >= limit[:, None]) & (most > -np.inf))
                new = [np.einsum("ij,ij->i", queries[a + r[i : i + 8192]], vectors[b + c[i : i + 8192]]) for i in range(0, len(r), 8192)]
                scored += len(r)
                row, score, ident = np.concatenate((row, r)), np.concatenate((score, *new)), np.concatenate((ident, ids[some][c]))
                best = grid.first_by_score(row, score, ident, k)
                row, score, ident = row[best], score[best], ident[best]
                least = np.full(n, np.inf)
                np.minimum.at(least, row, score)
                limit = np.where(np.bincount(row, minlength=n) >= k, least, limit)
        found.append((row + a, ident, score))
    place, ident, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return place, ident, score, scored


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dims): rows with an id and a vector that is neither zero nor broken; of repeated ids the least vector stays."""
    some = vectors.where(F.col(id_col).isNotNull() & grid.usable(vector_col) & F.exists(vector_col, lambda x: x != 0))
    least = some.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("v"))
    return least.withColumn("dims", F.size("v"))


def mean(rows: DataFrame) -> np.ndarray:
    """The mean of all vectors of the most frequent number of components; the one of others is taken as zero."""
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if most is None:
        return np.zeros(0)
    parts = rows.where(F.col("dims") == most["dims"]).select(F.posexplode("v"))
    means = parts.groupBy("pos").agg(F.round(F.avg(F.col("col").cast("double")), 6).alias("m")).orderBy("pos").collect()
    return np.array([r["m"] for r in means])


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Codes and scalars of every usable row beside its vector, written to the shared folder, and the center."""
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    center = mean(rows)
    kind = rows.schema["v"].dataType.simpleString()

    def coded(c: dict[str, pa.Array]) -> dict[str, object]:
        dims = np.asarray(c["dims"])
        codes, length, fit = [b""] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x, y, z = encode(grid.matrix(pa.chunked_array([c["v"].take(at)])), _center(center, d))
            length[at], fit[at] = y, z
            for i, code in zip(at, x):
                codes[i] = code.tobytes()
        return {**c, "code": codes, "length": length, "fit": fit}

    return written(map_rows(rows, f"id long, v {kind}, dims int, code binary, length double, fit double", coded), "codes"), center


def _center(center: np.ndarray, dims: int) -> np.ndarray:
    return center if len(center) == dims else np.zeros(dims)


def search(coded: DataFrame, center: np.ndarray, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row of the index for which ``is_query`` (on ``id``) holds.

    Queries meet all rows of the same number of components in blocks; of each block the best ``k`` go on.
    """

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        place = ident = score = ids = np.zeros(0, np.int64)
        if asked.num_rows and rows.num_rows:
            ids, queries = np.asarray(asked["id"]), grid.matrix(asked["v"])
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            place, ident, score, _ = nearest(
                ids, queries, np.asarray(rows["id"]), grid.matrix(rows["v"]), codes,
                np.asarray(rows["length"]), np.asarray(rows["fit"]), _center(center, queries.shape[1]), k,
            )
        return pa.table({"query_id": pa.array(ids[place], pa.int64()), "vec_id": pa.array(ident, pa.int64()), "score": pa.array(score, pa.float64())})

    queries = coded.where(is_query).select("id", "v", "dims")
    best = grid.meet(queries, coded, "dims", "id", "id", run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of all rows of ``vectors`` for which ``is_query`` (on a column ``id``) holds.

    Ids are whole numbers. Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite component,
    take no part; of repeated ids the least vector (in array order) does. Vectors meet those of as many components only. Fewer
    candidates than ``k`` are all returned; ties go to the smaller id; an empty table gives no rows; other columns are not read.
    """
    coded, center = index(vectors, id_col, vector_col)
    return search(coded, center, is_query, k)
