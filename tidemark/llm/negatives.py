"""Hard negatives by Fagin's threshold algorithm.

Each block of rows has, for every component, a list of its rows sorted by it. For an anchor the lists are read from
the end that its sign favours, all to the same depth. Rows met for the first time are scored at once by their whole
vector. No row that was not met can score more than the threshold, the anchor times the last values read. Each window of
scores keeps its first rows; reading ends when the threshold is strictly below the last score kept in every window, or
below the window itself (rows of equal score still compete by id, hence strictly). The first rows of all blocks make
up those of the table.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import grid
from tidemark.llm.common import written

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which negatives must lie.
LEAST_PERCENT, MOST_PERCENT = 30, 90
SCALE = 256
#: Depth of the first reading; each further one is twice as deep.
_DEPTH = 32


class Lists:
    """Rows of a block with their sorted lists, one for each component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        # Products and sums of whole numbers below 2**53 are exact in double precision, where they are fastest.
        largest = int(np.abs(vectors).max(initial=0))
        self.exact = largest**2 * max(1, vectors.shape[1]) < 2**53
        self.vectors = vectors.astype(np.float64) if self.exact else vectors
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.order = order.astype(np.int32)
        self.sorted = np.take_along_axis(vectors, order, axis=0)

    def first(self, anchor_id: int, anchor: np.ndarray, label: int, same: bool, windows: list[tuple[float, float]], k: int):
        """For each window (least, most) the first ``k`` (score, id) of rows of the same or of other labels, and the rows scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        exact = self.exact and int(np.abs(anchor).max(initial=0)) ** 2 * len(anchor) < 2**53
        factor = anchor.astype(np.float64) if exact else anchor
        seen = np.zeros(n, bool)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        depth, step, met = 0, _DEPTH, 0
        while depth < n:
            to = min(n, depth + step)
            now = np.zeros(n, bool)
            if len(up) + len(down):
                now[self.order[depth:to, up]] = True
                now[self.order[n - to : n - depth, down]] = True
            else:
                now[depth:to] = True
            new = np.flatnonzero(now & ~seen)
            seen |= now
            met += len(new)
            score = (self.vectors[new] @ factor).astype(np.int64)
            fit = ((self.labels[new] == label) == same) & (self.ids[new] != anchor_id)
            score, ident = score[fit], self.ids[new][fit]
            last = anchor[up] @ self.sorted[to - 1, up] + anchor[down] @ self.sorted[n - to, down]
            done = True
            for i, (least, most) in enumerate(windows):
                old_score, old_id = kept[i]
                inside = (score >= least) & (score <= most)
                if len(old_id) == k:
                    inside &= score >= old_score[-1]
                if inside.any():
                    s, d = np.concatenate((old_score, score[inside])), np.concatenate((old_id, ident[inside]))
                    best = np.lexsort((d, -s))[:k]
                    kept[i] = s[best], d[best]
                full = len(kept[i][1]) == k
                done &= bool(last < least or (full and last < kept[i][0][-1]))
            if done or met == n:
                break
            depth, step = to, step * 2
        return kept, met


def rows_of(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, v, dims) of the rows that take part, with whole components; of repeated ids the least label and vector stays."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE))
    some = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & grid.usable(vector_col))
    one = some.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(label.cast("long").alias("label"), whole.alias("v"))).alias("r"))
    return one.select("id", "r.label", "r.v", F.size("r.v").alias("dims"))


_FOUND = "anchor_id long, window long, score long, id long"


def _search(anchors: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each window of each anchor (anchors: id, label, v, dims, windows), with their rank."""

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if asked.num_rows and block.num_rows:
            lists = Lists(np.asarray(block["id"]), np.asarray(block["label"]), grid.matrix(block["v"], np.int64))
            vectors = grid.matrix(asked["v"], np.int64)
            for i, (anchor, label, windows) in enumerate(zip(*(asked[c].to_pylist() for c in ("id", "label", "windows")))):
                limits = [(w["least"], w["most"]) for w in windows]
                kept, _ = lists.first(anchor, vectors[i], label, same, limits, k)
                for w, (score, ident) in zip(windows, kept):
                    for column, part in zip(out, (np.full(len(ident), anchor), np.full(len(ident), w["key"]), score, ident)):
                        column.append(part)
        names = ("anchor_id", "window", "score", "id")
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(names, out)})

    found = grid.meet(anchors, rows, "dims", "id", "id", run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``is_anchor`` (on ``id``) holds.

    Components x become floor(256 * x); a score is the whole inner product with the anchor. An anchor's positives are its
    first ``positives`` other rows of its label; each has the first ``negatives`` rows of other labels whose score lies
    between 30 and 90 percent of the positive's. Ties go to the smaller id. Rows without id or label, and vectors that are null, empty
    or hold a null or non-finite component, take no part; of repeated ids the least (label, whole vector) does. Vectors
    meet those of as many components only. Anchors without positives, and windows without rows, give no rows, as does an empty
    table; other columns are not read. Scores are exact within the range of a long.
    """
    label = F.col("label") if label is None else label
    rows = written(rows_of(vectors, label, id_col, vector_col), "rows")
    anchors = rows.where(is_anchor)
    everything = F.struct(F.lit(0).cast("long").alias("key"), F.lit(-(2**63)).alias("least"), F.lit(2**63 - 1).alias("most"))
    first = _search(anchors.withColumn("windows", F.array(everything)), rows, True, positives)
    # At most ``positives`` rows of an anchor.
    near = written(first.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("id").alias("key"), "score")).alias("near")), "positives")
    windows = F.transform(
        "near",
        lambda p: F.struct(
            p["key"].alias("key"),
            F.ceil(p["score"].cast("decimal(20,0)") * F.lit(Decimal(LEAST_PERCENT) / 100)).cast("long").alias("least"),
            F.floor(p["score"].cast("decimal(20,0)") * F.lit(Decimal(MOST_PERCENT) / 100)).cast("long").alias("most"),
        ),
    )
    asked = anchors.join(near, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "dims", windows.alias("windows"))
    found = _search(asked, rows, False, negatives)
    scores = near.select("anchor_id", F.explode("near").alias("p")).select("anchor_id", F.col("p.key").alias("window"), F.col("p.score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "window"]).select(
        "anchor_id", F.col("window").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
