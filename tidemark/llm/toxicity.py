"""Toxicity: a logistic classifier on words whose score is kept from depending on whom a text mentions.

Features are the distinct words of the whole text and their beginnings, those that tell toxic from other texts in the labelled sample, and the
identity terms. In every sentence of a labelled text that mentions a group, each identity term is swapped for every other of its
kind in turn; the squared change of the score is part of the loss, so that the mention of a group alone moves no score. A
labelled text without any mention has its sentences take turns: one of them is filled with each pair of terms of one kind, so that the
penalty acts whatever groups the sample mentions.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.common import map_rows, written

#: Labelled rows to fit on, at most, and words of the model, at most.
SAMPLE_ROWS = 12_000
VOCABULARY = 3000
THRESHOLD = 0.3
#: Weight of the counterfactual penalty and of the squared weights.
COUNTERFACTUAL, RIDGE = 5.0, 1e-4
#: Lengths of the beginnings of words that are features.
STEM_CHARS = (4, 5, 6)
#: A feature belongs to the model from so many standard errors of its share among toxic and other texts on,
#: if so many of the sample's texts have it: a number and a share of the sample.
_EVIDENT, _LEAST_TEXTS, _LEAST_SHARE = 4.0, 3, 5e-4
_WORD = re.compile(r"\w+")

#: Identity terms by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("immigrant", "refugee", "citizen", "foreigner"),
    ("disabled", "blind", "deaf", "autistic"), ("elderly", "young"), ("poor", "rich"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "flüchtlinge", "bürger"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("immigrés", "réfugiés", "citoyens"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("inmigrantes", "refugiados", "ciudadanos"), ("negros", "blancos"),
)
#: Every term with the others of its kind.
PARTNERS = {a: tuple(b for b in kind if b != a) for kind in IDENTITY_TERMS for a in kind}
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """The words and their beginnings, marked by a star, which stand for a stem with any ending."""
    return found.union(*({w[:n] + "*" for w in found if len(w) >= n} for n in STEM_CHARS))


def _change(before: set[str], after: set[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    a, b = features(before), features(after)
    return tuple(sorted(a - b)), tuple(sorted(b - a))


def counterfactuals(text: str | None) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """For each counterfactual sentence of a text, the features that the swap takes away and those that it brings.

    A sentence that has the partner already loses the term only.
    """
    sentences = [words(s) for s in _SENTENCE.split(text or "")]
    out = []
    for found in sentences:
        for term in sorted(found & PARTNERS.keys()):
            out += [_change(found, found - {term} | {other}) for other in PARTNERS[term]]
    if out:
        return out
    # No group is mentioned: a sentence and a kind, chosen by the text's checksum, are filled with each pair of terms.
    some = [s for s in sentences if s] or [set()]
    number = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    found, kind = some[number % len(some)], IDENTITY_TERMS[number // 7 % len(IDENTITY_TERMS)]
    return [_change(found | {a}, found | {b}) for i, a in enumerate(kind) for b in kind[i + 1 :]]


@dataclass
class Toxicity:
    """Weights by word, the constant, and the number of counterfactual sentences that the fit was held to."""

    weights: dict[str, float]
    constant: float
    pairs: int = 0

    def score(self, text: str | None) -> float:
        z = self.constant + sum(sorted(self.weights[w] for w in self.weights.keys() & features(words(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class _Rows:
    """Sets of word numbers as one sparse matrix."""

    def __init__(self, sets: list[list[int]], width: int):
        self.n, self.width = len(sets), width
        self.row = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.col = np.array([i for s in sets for i in s], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=self.width)


def fit_weights(
    sets: list[list[int]], labels: np.ndarray, gone: list[list[int]], come: list[list[int]], counts: np.ndarray, width: int, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and constant of least loss: logistic, plus ridge, plus the mean squared change over the counterfactuals.

    A counterfactual takes the weights ``gone`` from a sentence and adds those of ``come``; it occurs ``counts`` times.
    Plain gradient steps with momentum and a step size per weight, from zero, so that the result is the same every time.
    """
    x, less, more = _Rows(sets, width), _Rows(gone, width), _Rows(come, width)
    share = counts / max(1, counts.sum())
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -50, 50)))
        r = (p - labels) / max(1, len(labels))
        g = np.concatenate((x.back(r) + RIDGE * w[:-1], [r.sum()]))
        if len(share):
            change = 2 * COUNTERFACTUAL * share * (more.dot(w[:-1]) - less.dot(w[:-1]))
            g[:-1] += more.back(change) - less.back(change)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1))
    return w[:-1], float(w[-1])


def _vocabulary(sample: DataFrame, limit: int) -> list[str]:
    """The words that tell the classes apart, at most ``limit``, and all identity terms."""
    sizes = sample.agg(F.sum("label"), F.count("label")).first()
    n, n_all = float(sizes[0] or 0), float(sizes[1] or 0)
    if n in (0.0, n_all):
        return sorted(PARTNERS)
    least = max(_LEAST_TEXTS, _LEAST_SHARE * n_all)
    word = sample.select(F.explode("features").alias("word"), "label").groupBy("word").agg(F.sum("label").alias("a"), F.count("label").alias("c"))
    share = F.col("c") / n_all
    error = F.sqrt(share * (1 - share) * (1 / n + 1 / (n_all - n)))
    far = F.abs(F.col("a") / n - (F.col("c") - F.col("a")) / (n_all - n)) / F.when(error > 0, error)
    top = word.where(F.col("c") >= least).select("word", far.alias("z")).where(F.col("z") >= _EVIDENT).orderBy(F.desc("z"), "word").limit(limit)
    return sorted({r.word for r in top.collect()} | set(PARTNERS))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> Toxicity:
    """Fits on at most ``sample_rows`` labelled documents; ``learn`` says which ids may be used."""
    texts = labelled.sample(docs, labels, label_col, learn, sample_rows, id_col, text_col)

    def featured(c: dict[str, pa.Array]) -> dict[str, object]:
        text = c["text"].to_pylist()
        changes = [[{"gone": list(a), "come": list(b)} for a, b in counterfactuals(t)] for t in text]
        return {"label": c["label"], "features": [sorted(features(words(t))) for t in text], "changes": changes}

    schema = "label int, features array<string>, changes array<struct<gone:array<string>,come:array<string>>>"
    sample = written(map_rows(texts, schema, featured, text="text"), "toxicity")
    number = {w: i for i, w in enumerate(_vocabulary(sample, VOCABULARY))}

    def numbered(c: dict[str, pa.Array]) -> dict[str, object]:
        return {"label": c["label"], "plain": [sorted(number[w] for w in x if w in number) for x in c["features"].to_pylist()]}

    rows = sorted((r.plain, r.label) for r in map_rows(sample.select("label", "features"), "label int, plain array<int>", numbered).collect())
    # Different changes are few: pairs of terms, with the beginnings that a sentence has besides.
    changes = sample.select(F.explode("changes").alias("c")).groupBy("c.gone", "c.come").count().collect()
    pick = lambda x: sorted(number[w] for w in x if w in number)
    pairs = sorted((pick(r.gone), pick(r.come), r["count"]) for r in changes)
    weights, constant = fit_weights(
        [a for a, _ in rows], np.array([y for _, y in rows], float), [a for a, _, _ in pairs], [b for _, b, _ in pairs],
        np.array([n for *_, n in pairs], float), len(number),
    )
    return Toxicity({w: float(weights[i]) for w, i in number.items()}, constant, int(sum(n for *_, n in pairs)))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document, from its whole text alone.

    A null text counts as empty, and an empty one gets the score of a text without any word of the model. Repeated
    rows stay; other columns are not read; no rows give no rows. Without labelled rows every score is 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = map_rows(
        docs, f"id {docs.schema['id'].dataType.simpleString()}, score double",
        lambda c: {"id": c["id"], "score": [sent.value.score(t) for t in c["text"].to_pylist()]}, text="text",
    )
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The documents with a score below the threshold, unchanged; a null or empty text is scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        mild = pa.array([sent.value.score(t) < THRESHOLD for t in c[text_col].to_pylist()], pa.bool_())
        return {n: x.filter(mild) for n, x in c.items()}

    return map_rows(docs, ddl, rows, text=text_col)
