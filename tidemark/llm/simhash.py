"""Near-duplicates by SimHash: a byte-position index with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints that differ in at most four bits agree
in at least four positional bytes, since a differing bit spoils one byte. The index therefore posts each distinct
fingerprint under groups of three positional bytes, chosen such that any four positions contain one of the groups
(the Turan system of 20 triples on eight points). Postings of single bytes would join one fingerprint in 256 with
every other, which grows with the square of the input; triples meet about one in 16 million by chance and lose
no pair. Pairs that meet are tallied over all eight positions, kept from four equal bytes on, and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, utf8, written
from tidemark.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: Fingerprints of one posting list that one task compares; longer lists are cut into pairs of chunks.
LIST_CHUNK = 4096
#: Fingerprints hashed at a time within a long text.
_BLOCK = 1 << 16


def _byte_groups() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four of the eight positions contain at least one of them."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for p in parts for t in combinations(p, 3)]
    across = [(*two, one) for p, q in zip(parts, parts[1:] + parts[:1]) for two in combinations(p, 2) for one in q]
    return inside + across


def fingerprint(text: bytes) -> int:
    """The SimHash of one text, as a signed 64-bit integer; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE_WORDS, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        hashes = [
            xxhash.xxh64_intdigest(line[s:e], HASH_SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])
        ]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, fp): one row per document, with a 128-bit key of id and text; a null or empty text has the fingerprint zero."""
    docs = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text")
    kind = docs.schema["id"].dataType.simpleString()
    return map_rows(
        docs,
        f"id {kind}, k1 long, k2 long, fp long",
        lambda c: {n: c[n] for n in ("id", "k1", "k2")} | {"fp": [fingerprint(t) for t in utf8(c["text"])]},
        text="text",
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = [F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(id_col), F.col(text_col)]
    return docs.withColumns({"k1": F.xxhash64(*row), "k2": F.xxhash64(F.lit(1), *row)})


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as needed for the same components: every node with the smallest one it reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        if (least == root[x]).all() and (least == root[y]).all():
            break
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the posting lists of a partition that is sorted by list."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held = [np.concatenate((*held, new), axis=1)] if held else [new]
        rows = held[0]
        last = (rows[:2] == rows[:2, -1:]).all(0)
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = [rows[:, cut:]]
        if cut:
            yield _linked(rows[:, :cut])
    if held:
        yield _linked(held[0])


def _linked(rows: np.ndarray) -> pa.RecordBatch:
    key, tile, fp = rows
    lag, at = 1, np.arange(len(key) - 1)
    a, b = [], []
    while len(at):
        at = at[at + lag < len(key)]
        at = at[(key[at] == key[at + lag]) & (tile[at] == tile[at + lag])]
        differ = fp[at] ^ fp[at + lag]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (tally >= 8 - MAX_BITS) & (np.bitwise_count(differ.view(np.uint64)) <= MAX_BITS)
        a.append(fp[at[near]])
        b.append(fp[at[near] + lag])
        lag += 1
    a, b = _forest(np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(fps: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) that have the same components as all pairs within four bits.

    A posting list longer than ``chunk`` is dealt to pairs of chunks, so that no task holds more than about two of
    them. Within one list only a spanning forest of the verified pairs is returned, never all of them.
    """
    parts = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [
        F.lit(n << 24) + F.shiftleft(parts[i], 16) + F.shiftleft(parts[j], 8) + parts[k]
        for n, (i, j, k) in enumerate(_byte_groups())
    ]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_lists = (
        posted.groupBy("key").count().where(F.col("count") > chunk)
        .select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    posted = posted.join(long_lists, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(own, other).cast("long") * F.col("chunks") + F.greatest(own, other),
    )
    dealt = posted.select("key", F.explode(tiles).alias("tile"), "fp")
    dealt = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "fp")
    return dealt.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): every document with its SimHash and the smallest id it is linked to.

    Documents are linked if their fingerprints differ in at most four bits; links chain. A null or empty text has the
    fingerprint zero and is linked like any other. Rows that repeat an id stay rows of their own. A null id is
    passed over for ``component_id`` unless a component has no other. Other columns are not read; an empty
    table gives an empty one.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    classes = _classes(fps)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, least, root): every fingerprint with its smallest id and the smallest fingerprint it is linked to."""
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(least.select("fp")))
    return least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id.

    A document without an id stays only if its component has no id at all. Documents that repeat the smallest id are
    told apart by a hash of the text, and rows that repeat id and text are one document.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    marked = fps.join(_classes(fps).select("fp", "root"), "fp")
    best = marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("best"))
    kept = best.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    keyed = _keyed(keyed.withColumn("_text", F.col(f"c{names.index(text_col)}").cast("string")), f"c{names.index(id_col)}", "_text")
    rows = keyed.drop("_text").join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return rows.drop("k1", "k2").toDF(*names)
