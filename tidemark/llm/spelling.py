"""Spelling variants: words that differ by one letter, found through one-edit neighbourhoods in a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Two words that differ by one inserted, deleted or replaced letter have reduced
words that differ by one at most, so that each stands in the other's full one-edit neighbourhood. A reduced
word of n symbols has (2 * SYMBOLS + 1) * n + SYMBOLS neighbours, with repeats; each is named by a polynomial hash, which costs one
step whatever the word's length. Neighbourhoods are joined with the reduced vocabulary, and what meets is verified
on the words themselves: equal hashes of different neighbours only add work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, written

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Code points and occurrences of a word, at least; how many times more frequent than a word its form must be.
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: A run loses a letter where this divides its checksum.
LOSS_DIVISOR = 199
#: Fixed value: the letters of a run.
LETTERS = "[A-Za-zÀ-ÿ]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def symbols(word: str) -> np.ndarray:
    """The reduced word: a number from 1 to ``SYMBOLS`` for each code point."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (points * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced_hash(word: str) -> int:
    s = symbols(word)
    return int((s * _powers(len(s) + 1)[:-1]).sum(dtype=np.uint64))


def neighbourhood(word: str) -> np.ndarray:
    """Distinct hashes of all reduced words at most one insertion, deletion or replacement away, the word's own included."""
    s = symbols(word)
    power = _powers(len(s) + 1)
    term = s * power[:-1]
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
    total = before[-1]
    deleted = before[:-1] + (total - before[1:]) * np.uint64(_INVERSE)
    letter = np.arange(1, SYMBOLS + 1, dtype=np.uint64)[:, None]
    replaced = (total - term) + letter * power[:-1]
    inserted = before + (total - before) * np.uint64(_BASE) + letter * power
    return np.unique(np.concatenate((deleted, replaced.ravel(), inserted.ravel())))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of whole texts that are long and frequent enough, after some runs lost a letter.

    A run shorter than a word can be is no match, and a longer one is matched as a whole, so that the pattern leaves
    short runs out from the start. The checksum of a null id is that of an empty one; a null text has no words.
    """
    run = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(f"{LETTERS}{{{LEAST_LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % LOSS_DIVISOR == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of ``words`` (word, n; each once) that differ by exactly one edit.

    Spark sizes a neighbourhood as the one word that it comes from, a hundredth of its rows, and would broadcast all of them; the hint rules that out.
    """

    def hashed(c: dict[str, pa.Array]) -> dict[str, object]:
        own = np.array([reduced_hash(w) for w in c["word"].to_pylist()], np.uint64).view(np.int64)
        return {"h": own, "near": c["word"], "near_n": c["n"]}

    def neighbours(c: dict[str, pa.Array]) -> dict[str, object]:
        around = [neighbourhood(w) for w in c["word"].to_pylist()]
        rows = np.repeat(np.arange(len(around)), [len(a) for a in around])
        every = np.concatenate(around).view(np.int64) if around else np.zeros(0, np.int64)
        return {"h": every, "word": c["word"].take(pa.array(rows))}

    reduced = map_rows(words, "h long, near string, near_n long", hashed)
    around = map_rows(words.select("word"), "h long, word string", neighbours, text="word")
    met = around.join(reduced.hint("merge"), "h").where(F.col("word") != F.col("near"))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n; each once).

    A word's form is its most frequent near word (ties: the smallest in code-point order), if at least five times as
    frequent as the word; the root is the last form reached. Counts grow by five from form to form, which
    bounds the chain by their logarithm; each round of joins doubles how far a root reaches. Tables of words are sized by their
    compressed files, and never broadcast.
    """
    words = written(words, "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    counted = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )
    good = F.col("near_n") >= FORM_FACTOR * F.col("n")
    named = written(
        counted.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms"
    )
    most = named.where("form is not null").agg(F.max("form_n")).first()[0]
    roots = named.where("form is not null").select("word", F.col("form").alias("root"))
    hops = 1 if most is None else int(math.log(max(most, FORM_FACTOR), FORM_FACTOR)) + 1
    for _ in range(math.ceil(math.log2(hops))):
        further = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = roots.join(further.hint("merge"), F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        roots = written(roots, "roots")
    return named.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Vocabulary of the whole texts of ``docs`` with near words, forms and roots (see :func:`variants`).

    Null and empty texts have no words; repeated rows count each time; no rows, or no frequent words, give no rows; other columns
    are not read.
    """
    return variants(vocabulary(docs, id_col, text_col))
