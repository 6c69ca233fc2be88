"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of its terms: words and runs of three bytes, both hashed to a fixed number of places. Beside them, as
a third part of the vector, stand runs of three classes of bytes and binned shares of distinct words and repeated lines,
which tell how a text is written. Weighted by the inverse document frequency of the labelled sample and brought to length one, the sample
is decomposed (a truncated singular value decomposition by subspace iteration); a text's latent vector is its projection. The
sample's vectors are broadcast, their number bounded by ``SAMPLE_ROWS``. Each document is compared with all of them, exactly,
in blocks, and its nearest neighbours vote with a weight that grows with the cosine.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.common import map_rows, utf8

#: Labelled rows to fit on, at most.
SAMPLE_ROWS = 6000
DIMENSIONS = 64
NEIGHBOURS = 31
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 48
THRESHOLD = 0.3
_BLOCK_DOCS = 256
_BLOCK_BYTES = 1 << 20

_N_WORDS, _N_GRAMS, _N_CLASSES, _BINS = 4096, 4096, 7, 8
_N_SHAPES = _N_CLASSES**3 + 3 * _BINS
TERMS = _N_WORDS + _N_GRAMS + _N_SHAPES
#: Length of the shape part of a vector; those of words and of runs of bytes have length 1.
_SHAPE_WEIGHT = 1.0
#: Weight of a bin, beside logarithms of counts per thousand bytes.
_BIN_WEIGHT = 3.0
#: Axes beyond those kept, and rounds, of the subspace iteration.
_SPARE_AXES, _ROUNDS = 16, 4


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, blank, newline, other ASCII, others."""
    kinds = np.full(256, 6, np.int64)
    kinds[33:127] = 5
    for kind, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r")):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


_CLASS = _classes()


def terms(text: bytes) -> np.ndarray:
    """The term weights of one text, before the inverse document frequency: words, runs of three bytes, shapes."""
    out = np.zeros(TERMS, np.float32)
    words, grams, shapes = np.split(out, (_N_WORDS, _N_WORDS + _N_GRAMS))
    found, lines = text.lower().split(), [x for x in text.split(b"\n") if x]
    counted = Counter(found)
    np.add.at(words, [zlib.crc32(w) % _N_WORDS for w in counted], np.fromiter(counted.values(), np.float32, len(counted)))
    for at in range(0, max(0, len(text) - 2), _BLOCK_BYTES):
        b = np.frombuffer(text, np.uint8, min(_BLOCK_BYTES + 2, len(text) - at), at).astype(np.int64)
        grams += np.bincount((b[:-2] * 40503 + b[1:-1] * 2531 + b[2:] * 157) % _N_GRAMS, minlength=_N_GRAMS)
        k = _CLASS[b]
        triples = (k[:-2] * _N_CLASSES + k[1:-1]) * _N_CLASSES + k[2:]
        shapes[: _N_CLASSES**3] += np.bincount(triples, minlength=_N_CLASSES**3)
    np.log1p(out * (1000 / max(1, len(text))), out=out)
    shares = (1 - len(set(lines)) / max(1, len(lines)), len(counted) / max(1, len(found)), min(1.0, len(found) / 2000))
    for i, share in enumerate(shares):
        shapes[_N_CLASSES**3 + _BINS * i + min(_BINS - 1, int(share * _BINS))] = _BIN_WEIGHT
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each part (words, runs of bytes, shapes) weighted and brought to its length, then the whole to length one."""
    parts = np.split(counts * weights, (_N_WORDS, _N_WORDS + _N_GRAMS), axis=1)
    return _unit(np.concatenate([_unit(parts[0]), _unit(parts[1]), _unit(parts[2]) * np.float32(_SHAPE_WEIGHT)], axis=1))


@dataclass
class Neighbours:
    """The fitted model: term weights, axes, and the labelled vectors."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Neighbours:
        """From each text's terms that are not 0: their places, and their weights."""
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(at for at, _ in rows)]), minlength=TERMS)
        weights = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + np.float32(0.3)

        def blocks() -> Iterator[np.ndarray]:
            for i in range(0, len(rows), _BLOCK_DOCS):
                x = np.zeros((len(rows[i : i + _BLOCK_DOCS]), TERMS), np.float32)
                for j, (at, value) in enumerate(rows[i : i + _BLOCK_DOCS]):
                    x[j, at] = value
                yield _weighted(x, weights)

        # The leading right singular vectors: a random subspace that is multiplied by the term products, and made orthogonal.
        axes = np.linalg.qr(np.random.default_rng(0).standard_normal((TERMS, DIMENSIONS + _SPARE_AXES)).astype(np.float32))[0]
        for _ in range(_ROUNDS):
            axes = np.linalg.qr(sum((x.T @ (x @ axes) for x in blocks()), np.zeros_like(axes)))[0]
        small = np.concatenate([np.zeros((0, axes.shape[1]), np.float32), *(x @ axes for x in blocks())])
        axes = axes @ np.linalg.eigh(small.T @ small)[1][:, ::-1][:, :DIMENSIONS]
        vectors = np.concatenate([np.zeros((0, DIMENSIONS), np.float32), *(x @ axes for x in blocks())])
        return cls(weights, axes, _unit(vectors), labels.astype(np.float32))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = _unit(_weighted(counts, self.weights) @ self.axes) @ self.vectors.T
        n = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, n - 1, axis=1)[:, :n]
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS + 1e-12
        return np.clip((votes * self.labels[near]).sum(1) / votes.sum(1), 0, 1)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> Neighbours:
    """Fits on at most ``sample_rows`` labelled documents; ``learn`` says which ids may be used."""
    texts = labelled.sample(docs, labels, label_col, learn, sample_rows, id_col, text_col)

    def counted(c: dict[str, pa.Array]) -> dict[str, object]:
        every = [terms(t) for t in utf8(c["text"])]
        at = [np.flatnonzero(x).astype(np.int32) for x in every]
        return {"label": c["label"], "places": [i.tobytes() for i in at], "weights": [x[i].tobytes() for x, i in zip(every, at)]}

    rows = sorted((bytes(r.places), bytes(r.weights), r.label) for r in map_rows(texts, "label int, places binary, weights binary", counted, text="text").collect())
    return Neighbours.fit([(np.frombuffer(a, np.int32), np.frombuffer(w, np.float32)) for a, w, _ in rows], np.array([y for *_, y in rows], np.float32))


def score(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document, from its whole text alone.

    A null text counts as empty; empty texts get the vote of their nearest neighbours like others. Repeated rows stay;
    other columns are not read. A model without labelled rows gives 0.5; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        texts, out = utf8(c["text"]), [np.zeros(0)]
        for at in range(0, len(texts), _BLOCK_DOCS):
            out.append(sent.value.scores(np.stack([terms(t) for t in texts[at : at + _BLOCK_DOCS]])))
        return {"id": c["id"], "score": np.concatenate(out)}

    scored = map_rows(docs, f"id {docs.schema['id'].dataType.simpleString()}, score double", rows, text="text")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
