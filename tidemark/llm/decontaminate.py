"""Benchmark decontamination: a broadcast hash set of the test items' word windows, scanned over all documents.

Words are hashed to 64 bits and a window's hash is made of those of its words. Up to ``BLOCK_BYTES`` of item text the set is
broadcast: sorted hashes with the place of one window each, a table of bits that passes most windows by, and the items' words,
with which every hit is verified. The documents are read once.

Larger sets of items are not broadcast, only their table of bits (``2 ** TABLE_BITS`` bits, whatever the items): document windows that
it lets through meet the items' windows in a join on the window's words, and what is found returns to the documents by the
digest of their text. Long items are cut into runs of words that overlap by one word less than a window, so
that no item is too long. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, utf8, written

WINDOW_WORDS = 13
#: Bytes of item text up to which windows are broadcast: some 45 MB of arrays.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: The table of bits has two to this power of them.
TABLE_BITS = 27
#: Words of a run of a long item, beside the overlap.
RUN_WORDS = 50_000
#: Distinct words whose hashes a task keeps.
_KEPT_WORDS = 200_000

_DELIMITER = b"".join(bytes([b]) for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_DELIMITER + bytes(range(65, 91)), b" " * len(_DELIMITER) + bytes(range(97, 123)))


def words(text: bytes) -> list[bytes]:
    """Words of letters, digits and bytes above 127, with A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Hasher:
    """Hashes of words and windows; the hashes of the words met last are kept."""

    def __init__(self, seed: int = 0):
        self.seed, self.kept = seed, {}

    def words(self, found: list[bytes]) -> np.ndarray:
        if len(self.kept) > _KEPT_WORDS:
            self.kept = {}
        kept, seed, out = self.kept, self.seed, []
        for w in found:
            h = kept.get(w)
            if h is None:
                h = kept[w] = xxhash.xxh64_intdigest(w, seed)
            out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def windows(hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of ``size`` words."""
        n = len(hashes) - size + 1
        out = np.full(max(0, n), size, np.uint64)
        for j in range(size if n > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        out ^= out >> np.uint64(32)
        return out * np.uint64(0xD6E8FEB86659FD93)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Table:
    """Bits of window hashes: every window of an item passes, few others do."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, hashes: np.ndarray) -> Table:
        bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        at = _slot(hashes)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return cls(bits)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        at = _slot(hashes)
        return np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


class Windows:
    """The distinct windows of some items, by length: sorted hashes, the place of each window, and its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)} | {None: -1}
        owner = np.array([number[name] for name, _ in items], np.int64)
        found = [words(text) for _, text in items]
        first = np.cumsum([0, *(len(x) for x in found)])
        self.text = b" ".join(w for x in found for w in x) + b" "
        self.starts = np.cumsum([0, *(len(w) + 1 for x in found for w in x)])
        self.seed = 0
        while not self._build(found, first, owner, width):
            self.seed += 1

    def _build(self, found: list[list[bytes]], first: np.ndarray, owner: np.ndarray, width: int) -> bool:
        """False if two different windows have the same hash: another seed is taken then."""
        hasher, made = Hasher(self.seed), {}
        for i, x in enumerate(found):
            size = min(width, len(x))
            if size:
                h = hasher.windows(hasher.words(x), size)
                made.setdefault(size, []).append((h, first[i] + np.arange(len(h)), np.full(len(h), owner[i])))
        self.sets = {}
        for size, parts in made.items():
            h, at, by = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((by, h))
            h, at, by = h[order], at[order], by[order]
            for i in np.flatnonzero(h[1:] == h[:-1]).tolist():
                if self.window(at[i], size) != self.window(at[i + 1], size):
                    return False
            # One row for each window and item; windows of items without a name have number -1.
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (by[1:] != by[:-1])))
            h, at, by = h[new], at[new], by[new]
            begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            self.sets[size] = (h[begins], at[begins].astype(np.int32), np.append(begins, len(h)).astype(np.int32), by.astype(np.int32))
        every = [s[0] for s in self.sets.values()]
        self.table = Table.of(np.concatenate(every) if every else np.zeros(0, np.uint64))
        return True

    def window(self, at: int, size: int) -> bytes:
        return self.text[self.starts[at] : self.starts[at + size] - 1]

    def scan(self, text: bytes, hasher: Hasher) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, the spans of words that are hit, and the named items that occur, sorted."""
        found = words(text)
        hashes = hasher.words(found)
        spans, items = [], []
        for size, (known, at, begins, by) in self.sets.items():
            h = hasher.windows(hashes, size)
            likely = self.table.passing(h)
            place = np.searchsorted(known, h[likely])
            same = known[np.minimum(place, len(known) - 1)] == h[likely]
            occurring = set()
            for i, k in zip(likely[same].tolist(), place[same].tolist()):
                if b" ".join(found[i : i + size]) == self.window(at[k], size):
                    spans.append((i, i + size))
                    occurring.add(k)
            items += [by[begins[k] : begins[k + 1]] for k in occurring]
        listed = np.unique(np.concatenate(items)) if items else ()
        return len(found), merged(spans), [self.names[i] for i in listed if i >= 0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` (whose columns have other names) with ``_words`` (their number), ``_spans`` (array of start, end in words) and ``_items`` (array).

    A window is ``width`` consecutive words of an item, or a shorter item as a whole. Null or empty texts and
    items have no words and no hits. Items without an id hit words but are not listed; repeated ids are listed once.
    """
    items = items.select(F.col(item_id_col).cast("string").alias("name"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined(docs, items, text_col, width)
    # At most ``block_bytes`` of text.
    sent = docs.sparkSession.sparkContext.broadcast(Windows([(r.name, r.text.encode()) for r in items.collect()], width))
    names = docs.columns

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        hasher = Hasher(sent.value.seed)
        found = [sent.value.scan(t, hasher) for t in utf8(c[text_col].cast(pa.string()))]
        spans = [[{"start": a, "end": b} for a, b in new] for _, new, _ in found]
        return {n: c[n] for n in names} | {"_words": [n for n, _, _ in found], "_spans": spans, "_items": [x for _, _, x in found]}

    return map_rows(docs, _scanned_schema(docs), rows, text=text_col)


def _scanned_schema(docs: DataFrame) -> str:
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return ", ".join([*own, "_words bigint", "_spans array<struct<start:int,end:int>>", "_items array<string>"])


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(name, hash, window) of items of any length, from ``name`` and ``text``; repeated ones stay."""

    def runs(c: dict[str, pa.Array]) -> dict[str, object]:
        names, texts = [], []
        for name, text in zip(c["name"].to_pylist(), utf8(c["text"])):
            found = words(text)
            for at in range(0, max(1, len(found) - width + 1), RUN_WORDS):
                names.append(name)
                texts.append(b" ".join(found[at : at + RUN_WORDS + width - 1]).decode())
        return {"name": names, "text": texts}

    def windows(c: dict[str, pa.Array]) -> dict[str, object]:
        hasher, names, hashes, texts = Hasher(), [], [np.zeros(0, np.int64)], []
        for name, text in zip(c["name"].to_pylist(), utf8(c["text"])):
            found = words(text)
            size = min(width, len(found))
            if size:
                hashes.append(hasher.windows(hasher.words(found), size).view(np.int64))
                names += [name] * len(hashes[-1])
                texts += [b" ".join(found[i : i + size]).decode() for i in range(len(hashes[-1]))]
        return {"name": names, "hash": np.concatenate(hashes), "window": texts}

    cut = map_rows(items, "name string, text string", runs, text="text")
    return map_rows(cut, "name string, hash bigint, window string", windows, text="text")


def _joined(docs: DataFrame, items: DataFrame, text_col: str, width: int) -> DataFrame:
    """:func:`scan` for items that are too many to broadcast."""
    spark = docs.sparkSession
    known = written(item_windows(items, width).distinct(), "windows")
    # The table's words of bits: 32,768 bits a row, 4,096 rows.
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    parts = known.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for r in parts:
        # Slot 0 has bucket 0; the others count from 1, for slots 1 to 32,768 and so on.
        _put(bits, r.n, np.frombuffer(r.bits, np.uint8))
    sizes = [r[0] for r in known.select(F.size(F.split("window", " "))).distinct().collect()]
    sent = spark.sparkContext.broadcast(Table(bits))

    def candidates(c: dict[str, pa.Array]) -> dict[str, object]:
        hasher, digests, starts, ends, texts = Hasher(), [], [], [], []
        for digest, text in zip(c["digest"].to_pylist(), utf8(c["text"])):
            found = words(text)
            hashes = hasher.words(found)
            for size in sizes:
                for i in sent.value.passing(hasher.windows(hashes, size)).tolist():
                    digests.append(digest)
                    starts.append(i)
                    ends.append(i + size)
                    texts.append(b" ".join(found[i : i + size]).decode())
        return {"digest": digests, "start": starts, "end": ends, "window": texts}

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    met = map_rows(read, "digest binary, start int, end int, window string", candidates, text="text").distinct()
    met = written(met.join(known.select("window").distinct(), "window", "left_semi"), "hits")
    spans = met.groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    named = known.where("name is not null").select("window", "name")
    listed = met.select("digest", "window").distinct().join(named, "window").groupBy("digest").agg(F.collect_set("name").alias("_items"))
    found = spans.join(listed, "digest", "left")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")), 256)))
    both = plain.join(found, "digest", "left").drop("digest")

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        spans = [
            [{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in old or ()])] for old in c["_spans"].to_pylist()
        ]
        counted = [len(words(t)) for t in utf8(c[f"c{names.index(text_col)}"].cast(pa.string()))]
        listed = [sorted(x or ()) for x in c["_items"].to_pylist()]
        return {n: c[f"c{i}"] for i, n in enumerate(names)} | {"_words": counted, "_spans": spans, "_items": listed}

    return map_rows(both, _scanned_schema(docs), rows, text=f"c{names.index(text_col)}")


def _put(bits: np.ndarray, bucket: int, part: np.ndarray) -> None:
    """Sets the bits of one row of Spark's bitmaps: bucket n holds positions from 32,768 * (n - 1) + 1 on, bucket 0 position 0."""
    at = np.flatnonzero(np.unpackbits(part, bitorder="little"))
    # Bucket 0 keeps position 0 as bit 0; bit i of bucket n is position 32,768 * (n - 1) + 1 + i.
    at = at if bucket == 0 else 32768 * (bucket - 1) + 1 + at
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def n_hit() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    return (n_hit() > 0) & (HIT_SHARE * n_hit() >= F.col("_words"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of :func:`scan`: words, words hit, items that occur and their digest, and the decision."""
    return scanned.select(
        id_col,
        F.col("_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, unchanged; columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = scan(plain, items, text_col=f"c{names.index(text_col)}", **options).where(~contaminated())
    return kept.select(plain.columns).toDF(*names)


def cut_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, without the words that are hit: each span goes from its first to its last word."""
    own, place = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(own))])
    names, text_col = docs.columns, f"c{place}"

    def cut(text: bytes, spans: list[dict[str, int]]) -> str:
        if not spans:
            return text.decode()
        folded, at, places = text.translate(_FOLD), 0, []
        for w in folded.split():
            at = folded.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        edges = [0, *(x for s in spans for x in (places[s["start"]][0], places[s["end"] - 1][1])), len(text)]
        return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        texts = [None if t is None else cut(t.encode(), s) for t, s in zip(c[text_col].to_pylist(), c["_spans"].to_pylist())]
        return {n: texts if n == text_col else c[n] for n in names}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(scan(docs, items, text_col=text_col, **options), schema, rows, text=text_col).toDF(*own)
