"""A bounded sample of labelled texts to fit a classifier on, and the split of rows by a checksum of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    learn: Column,
    rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(text, label): at most ``rows`` documents with a label, those whose id has the smallest hash.

    ``learn`` is a condition on the id. An id that is labelled both 0 and 1 counts as 1; of several texts of an id the
    smallest is taken. Null ids, labels and texts are left out.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # Bounded by ``rows``: ids and labels only.
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
