"""Document fingerprints by winnowing: rolling hashes of k-grams, the least of every window, with positions.

Of each window of ``WINDOW`` consecutive k-grams the one with the smallest hash is kept, of equal ones the rightmost. Two
texts that share ``GRAM + WINDOW - 1`` characters therefore share a kept hash, and the kept position says where; what
is shorter than ``GRAM`` is never matched. A text with fewer k-grams is one window; one shorter than ``GRAM`` is hashed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 25
WINDOW = 50

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Positions of a block take so many bits below the hash.
_PLACE_BITS = 20
_BLOCK = (1 << _PLACE_BITS) - GRAM - WINDOW


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers((1 << _PLACE_BITS) + 1, int(_BASE))
_DOWN = _powers((1 << _PLACE_BITS) + 1, pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive codes, from differences of one running polynomial modulo 2**64."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * _UP[: len(codes)])))
    n = len(codes) - size + 1
    return _mixed((sums[size:] - sums[:n]) * _DOWN[:n])


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes and their positions (code points), by position; nothing for an empty text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(GRAM, len(codes))
    width = min(WINDOW, len(codes) - size + 1)
    hashes, places = [], []
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, len(codes) - size - width + 2, _BLOCK):
        part = gram_hashes(codes[at : at + _BLOCK + size + width - 2], size)
        # The hash above, the position counted from the right below: the minimum is rightmost among equal hashes.
        least = (part & ~mask) | (mask - np.arange(len(part), dtype=np.uint64))
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        place = (mask - (least[np.concatenate(([True], least[1:] != least[:-1]))] & mask)).astype(np.int64)
        hashes.append(part[place] >> np.uint64(_PLACE_BITS))
        places.append(place + at)
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    new = np.concatenate(([True], places[1:] != places[:-1]))
    return hashes[new], places[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common hashes among all hashes of two fingerprints; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def rendered(hashes: np.ndarray, places: np.ndarray) -> str:
    """Hash (11 hexadecimal digits) and position of every kept gram."""
    return " ".join(f"{h:011x}:{p}" for h, p in zip(hashes.tolist(), places.tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash long, position long): the kept grams of every document, to match documents on; none for a null or empty text."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                h, p = fingerprint(text)
                ids = pa.array(batch.column(0).slice(i, 1).to_pylist() * len(h), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.astype(np.int64)), pa.array(p)], names=[id_col, "hash", "position"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, hash long, position long")


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, text) in ranges of descending id, each closed by a copy of the row that follows it (``guest``).

    Ranges end at quantiles of the ids, and at every id with more rows than an even range has, whose rows (like those
    without an id) are dealt by a hash of the text, the next key of the order. What is collected are quantiles and one
    key for each range.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    n = docs.count()
    marks = docs.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    heavy = docs.where("id is not null").groupBy("id").count().where(F.col("count") > max(1, n // buckets)).select("id").collect()
    alone = sorted(r.id for r in heavy)
    edges = sorted({*marks, *alone, *(x + 1 for x in alone)})
    place = F.lit(0)
    if edges:
        sorted_edges = F.array(*[F.lit(e).cast("long") for e in edges])
        place = F.size(F.filter(sorted_edges, lambda e: e <= F.col("id"))) + 1
    split = F.col("id").isNull() | F.col("id").isin(alone)
    seq = (F.lit(len(edges) + 2) - F.when(F.col("id").isNull(), -1).otherwise(place)) * 16 + F.when(split, F.lit(7) - F.shiftright("h", 60)).otherwise(0)
    docs = docs.withColumn("seq", seq.cast("int"))
    heads = docs.groupBy("seq").agg(F.max(F.struct("id", "h")).alias("head")).collect()
    heads = sorted((r["seq"], r["head"]["id"], r["head"]["h"]) for r in heads if r["head"])
    if not heads:
        return docs.withColumn("guest", F.lit(False))
    before = [(heads[i - 1][0], i_id, i_h) for i, (_, i_id, i_h) in enumerate(heads)]
    spark = docs.sparkSession
    first = spark.createDataFrame(before, "to int, head_id long, head_h long")
    guests = docs.join(F.broadcast(first), F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    guests = guests.groupBy("to").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("h").alias("h"))
    guests = guests.select("id", "text", "h", F.col("to").alias("seq"), F.lit(True).alias("guest"))
    return docs.withColumn("guest", F.lit(False)).unionByName(guests)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    The next document is the one that follows in descending id; ids are whole numbers, nulls come last, and rows of one id
    follow each other by a hash of the text, then the text. The last document is followed by the first, a single one
    by itself. The edited text has the last half (rounded down) of the code points replaced by as many from the start
    of the next document, or all that it has. Null texts are empty; other columns are not read; no rows give no rows.
    """
    buckets = buckets or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["seq", "guest", F.desc_nulls_last("id"), F.desc("h"), F.desc("text")]
    rows = _dealt(docs, buckets).repartition("seq").sortWithinPartitions(*order).select("seq", "guest", "id", "text")
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_compared, schema)


_OUT = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; every row but the guest that closes a range is compared with the row after it."""
    before = None
    out: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            guest, doc, text = (batch.column(k)[i].as_py() for k in (1, 2, 3))
            own = fingerprint(text)
            if before is not None:
                out.append(_row(*before, text, own[0]))
            before = None if guest else (doc, text, own)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], _OUT)
                out = []
    yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], _OUT)


def _row(doc: int | None, text: str, own: tuple[np.ndarray, np.ndarray], following: str, other: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc, len(text), digest, rendered(*own), rendered(*changed), likeness(own[0], changed[0]), likeness(own[0], other)
