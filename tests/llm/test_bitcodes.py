from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bitcodes, queries

SF_DIR = "/root/testdata/sf0.01"


def plain(rows: dict[int, np.ndarray], asked: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for q in asked:
        scored = [(v, float(np.dot(rows[q].astype(float), x.astype(float)))) for v, x in rows.items() if v != q and len(x) == len(rows[q])]
        out[q] = sorted(scored, key=lambda p: (-p[1], p[0]))[:k]
    return out


def lists(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got: dict, want: dict) -> float:
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def frame(spark, rows: dict[int, np.ndarray]):
    return spark.createDataFrame([(i, [float(y) for y in x], "a", 3) for i, x in rows.items()], "vec_id long, embedding array<double>, id string, v int")


@pytest.mark.parametrize("kind", ["random", "centred elsewhere", "clusters"])
def test_recall_and_scores_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 48))
    if kind == "centred elsewhere":
        x += 4 * rng.standard_normal(48)
    if kind == "clusters":
        x = x[rng.integers(0, 30, 3000)] + 0.05 * x
    rows = dict(enumerate(x))
    got, want = lists(bitcodes.nearest_neighbours(frame(spark, rows), F.col("id") % 60 == 0)), plain(rows, list(range(0, 3000, 60)), bitcodes.K)
    assert recall(got, want) >= 0.99
    for q, found in got.items():
        assert len(found) == bitcodes.K
        assert all(s == pytest.approx(float(rows[q] @ rows[v]), rel=1e-12) for v, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))


def test_bounds_spare_most_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, length, fit = bitcodes.encode(x, np.zeros(64))
    *_, scored = bitcodes.nearest(np.arange(40), x[:40], np.arange(8000), x, codes, length, fit, np.zeros(64), 20)
    assert scored < 0.15 * 40 * 8000


def test_estimates_lie_within_their_errors():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((2000, 33)) + 1, rng.standard_normal((200, 33))
    center = np.round(x.mean(0), 6)
    about, error = bitcodes.Queries(q, center).estimate(slice(0, 200), *bitcodes.encode(x, center))
    off = (about - q @ x.T) / error
    assert abs(off.mean()) < 0.1 and 0.7 < off.std() < 1.1 and (np.abs(off) > bitcodes.ERRORS).mean() < 0.01


def test_broken_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (9, [1.0]), (20, [1.0, 1.0, 1.0]), (40, [0.0, -2.0]), (None, [9.0, 9.0]), (2, [0.5, 0.5]), (1, [7.0, 7.0]), (60, [2.0]),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dims string")
    got = lists(bitcodes.nearest_neighbours(df, F.col("id") % 20 == 0))
    assert got == {0: [(1, 0.5), (2, 0.5), (40, 0.0)], 40: [(0, 0.0), (1, -1.0), (2, -1.0)], 60: [(9, 2.0)]}
    assert bitcodes.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_many_equal_vectors(spark):
    rows = {i: np.array([1.0, 2.0, 3.0]) for i in range(700)} | {1000 + i: np.array([3.0, 2.0, 1.0 + i]) for i in range(5)}
    assert lists(bitcodes.nearest_neighbours(frame(spark, rows), F.col("id") % 100 == 0)) == plain(rows, [*range(0, 700, 100), 1000], bitcodes.K)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")
def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = {r.vec_id: np.array(r.embedding) for r in table}
    want = plain(rows, [i for i in rows if i % 20 == 0], 20)
    got = lists(queries.QUERIES["op12_neighbours"](spark, SF_DIR))
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
