"""Removal of repeated byte strings of a fixed length, exactly and over all documents, with suffix arrays in shards.

A string of ``LENGTH`` bytes belongs to the gram in it with the smallest hash (the rightmost of equal ones). This depends on the
string alone, so equal strings belong to equal grams, wherever they stand. Strings with neighbouring starts that belong to one
gram form a piece. Pieces are dealt by gram; from then on:

* a gram that occurs once has no repeated string, and its piece goes no further;
* equal pieces of a gram are repeated as a whole; one of them stands for all;
* different pieces of a gram may share strings. Their bytes form shards, each of which gets a suffix array by
  induced sorting (:mod:`tidemark.llm.suffixes`), and starts with ``LENGTH`` bytes in common with a neighbour are repeated.

Texts are known by a 128-bit hash between the steps, and copies within a batch are sent once or twice, not all. The
rows of grams that a fixed sample shows in many documents are salted. A shard has the pieces of one gram, at most ``MANY_PIECES``
different ones; those of a gram with more are cut finely and dealt by the bytes that all their strings share, which gives a shard
one part of a piece at most. The pieces of grams with more than ``MANY_PARTS``, or with an unknown number, are cut to single
strings, which meet by a 128-bit hash: within a batch, then within a salt, then all that are left. So no shard, and nothing that a
task holds, depends on how often a gram occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, slices, utf8, written
from tidemark.llm.suffixes import common_prefixes, suffix_array
from tidemark.llm.winnowing import gram_hashes

LENGTH = 200
GRAM = 48
#: Documents that are looked at for grams in many documents, and the share of them that makes a gram hot.
HOT_SAMPLE, HOT_SHARE = 2000, 0.01
#: A hot gram's rows are dealt to so many groups.
SALTS = 64
#: Rows of a gram that a task holds at most, and the different pieces from which on a gram's pieces are cut finely.
HELD_ROWS, MANY_PIECES = 200_000, 2000
#: Starts of a finely cut piece, and the different pieces from which on a gram's pieces are cut to single strings.
FINE, MANY_PARTS = 16, 5000
#: Single strings that a task compares at a time, and the groups to which those left of one string are dealt.
HELD_STRINGS, STRING_SALTS = 100_000, 8
#: Bytes of a shard: pieces are added until it has so many.
SHARD_BYTES = 1 << 20

_BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: The last: many, and its own starts are spans already.
_SPAN, _ONE, _MANY, _KNOWN = 0, 1, 2, 3
_COARSE, _PARTS, _STRINGS = 0, 1, 2


def pieces(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of every piece, and the hash of its gram; nothing for a text below ``length``."""
    firsts, lasts, grams = [], [], []
    data = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, _BLOCK):
        hashes = gram_hashes(data[at : at + _BLOCK + length - 1], gram)
        least = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        firsts.append(new + at)
        lasts.append(np.append(new[1:], len(least)) - 1 + at)
        grams.append(hashes[(_PLACE - (least[new] & _PLACE)).astype(np.int64)])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(grams)


def _packed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First start and number of further starts (below 256) in one number."""
    return first * 256 + (last - first)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with the hash of their text; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select("*", text.alias("_t")).withColumns({"h1": F.xxhash64("_t"), "h2": F.xxhash64(F.lit(1), "_t")})


def _long_columns(names: str) -> str:
    return ", ".join(f"{n} long" for n in names.split())


_OCCURRENCE = "h1 h2 gram salt sig at"
_FOUND = "h1 h2 at kind gram fine"
_STRING = "shard s2 salt h1 h2 at kind"


def _batch(names: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=names.split())


def _occurrences(texts: DataFrame, hot: set[int], length: int, gram: int) -> DataFrame:
    hot_grams = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                seen: dict[tuple[int, int], int] = {}
                out: list[list[np.ndarray]] = []
                for h1, h2, text in zip(part.column("h1").to_pylist(), part.column("h2").to_pylist(), utf8(part.column("_t"))):
                    # Two rows of a text tell that it has copies; more would tell nothing new.
                    copies = seen[h1, h2] = seen.get((h1, h2), 0) + 1
                    if copies > 2:
                        continue
                    first, last, grams = pieces(text, length, gram)
                    sigs = [xxhash.xxh3_64_intdigest(text[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                    sig = np.array(sigs, np.uint64).astype(np.int64)
                    grams = grams.astype(np.int64)
                    salt = np.where(np.isin(grams, hot_grams), 1 + (sig ^ h1 ^ copies) % SALTS, 0)
                    out.append([np.full(len(first), h1), np.full(len(first), h2), grams, salt, sig, _packed(first, last)])
                if out:
                    yield _batch(_OCCURRENCE, [np.concatenate(c) for c in zip(*out)])
            pa.default_memory_pool().release_unused()

    return texts.select("h1", "h2", "_t").mapInArrow(run, _long_columns(_OCCURRENCE))


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, salt and signature: repeated pieces, and pieces to compare."""
    held: np.ndarray | None = None
    broken = None
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held = new if held is None else np.concatenate((held, new), axis=1)
        last = (held[2:4] == held[2:4, -1:]).all(0)
        cut = held.shape[1] - int(last.sum())
        if cut:
            yield _decided(held[:, :cut], broken)
            held = held[:, cut:]
        if held.shape[1] > HELD_ROWS:
            # Too many rows of one gram to hold: all are to be compared, which decides them as well.
            broken = held[2:4, -1].copy()
            yield _decided(held, broken)
            held = None
    if held is not None:
        yield _decided(held, broken)


def _decided(rows: np.ndarray, broken: np.ndarray | None) -> pa.RecordBatch:
    """Decides the rows of whole groups, except for the group of ``broken``, of which these are some rows."""
    h1, h2, gram, salt, sig, at = rows
    n = rows.shape[1]
    new_group = np.concatenate(([True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))[:n]
    new_run = new_group | np.concatenate(([True], sig[1:] != sig[:-1]))[:n]
    group, run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
    in_run, runs_of = np.bincount(run), np.bincount(group[new_run])
    repeated = in_run[run] > 1
    spread = salt > 0
    if broken is not None:
        spread |= (gram == broken[0]) & (salt == broken[1])
    fine = np.where(spread | (runs_of[group] > MANY_PARTS), _STRINGS, np.where(runs_of[group] > MANY_PIECES, _PARTS, _COARSE))
    asked = new_run & ((runs_of[group] > 1) | spread)
    a, b = np.flatnonzero(repeated), np.flatnonzero(asked)
    kind = np.concatenate((np.full(len(a), _SPAN), np.where(repeated[b], _MANY, _ONE)))
    pick = np.concatenate((a, b))
    return _batch(_FOUND, [h1[pick], h2[pick], at[pick], kind, gram[pick], fine[pick]])


def _contents(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_STRING`` and bytes: pieces and their parts with their bytes, single strings by their hash without, and spans."""
    unpack = zstandard.ZstdDecompressor()
    pieces_: list[tuple] = []
    strings: list[np.ndarray] = []
    size = n_strings = 0
    for batch in batches:
        for h1, h2, z, asked in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack.decompress(z)
            for x in asked:
                first, more = x["at"] >> 8, x["at"] & 255
                if x["fine"] == _STRINGS:
                    strings.append(_strings(text, first, more + 1, h1, h2, x["kind"], length))
                    n_strings += more + 1
                else:
                    starts = [(first, first + more, x["gram"])]
                    if x["fine"] == _PARTS:
                        anchor = _anchor(text[first : first + more + length], more + 1, gram, length) + first
                        starts = _fine(text, first, first + more, anchor, x["gram"], length)
                    for a, b, key in starts:
                        pieces_.append((key, 0, 0, h1, h2, a * 256 + b - a, x["kind"], text[a : b + length]))
                        size += b - a + length
                if n_strings >= HELD_STRINGS:
                    yield _with_bytes(_met_in_batch(strings))
                    strings, n_strings = [], 0
                if size > 1 << 22:
                    yield _with_bytes(pieces_)
                    pieces_, size = [], 0
        pa.default_memory_pool().release_unused()
    if pieces_:
        yield _with_bytes(pieces_)
    if strings:
        yield _with_bytes(_met_in_batch(strings))


def _with_bytes(rows: list[tuple] | np.ndarray) -> pa.RecordBatch:
    columns = list(zip(*rows)) if isinstance(rows, list) else [*rows, [None] * rows.shape[1]]
    types = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*_STRING.split(), "bytes"])


def _strings(text: bytes, first: int, n: int, h1: int, h2: int, kind: int, length: int) -> np.ndarray:
    """Columns of ``_STRING`` for ``n`` starts; the first two are the hash of the string."""
    digests = b"".join([xxhash.xxh3_128_digest(text[i : i + length]) for i in range(first, first + n)])
    out = np.zeros((7, n), np.int64)
    out[:2] = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    out[3], out[4], out[5], out[6] = h1, h2, np.arange(first, first + n) * 256, kind
    return out


def _alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of columns of ``_STRING`` sorted by hash and salt: those found to be repeated, and one of each run, which says so."""
    new_run = np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(0)))
    run = np.cumsum(new_run) - 1
    many = (np.bincount(run) > 1) | (np.bincount(run, rows[6] != _ONE) > 0)
    one = rows[:, new_run]
    one[6] = np.where(many, _KNOWN, _ONE)
    return rows[:, many[run] & (rows[6] != _KNOWN)], one


def _as_spans(rows: np.ndarray) -> np.ndarray:
    """The columns as spans that are found, neighbouring starts in one, dealt by their text."""
    rows = rows[:, np.lexsort((rows[5], rows[4], rows[3]))]
    place, n = rows[5] >> 8, rows.shape[1]
    apart = (rows[3:5, 1:] != rows[3:5, :-1]).any(0) | (place[1:] != place[:-1] + 1) | (place[1:] % 256 == 0)
    first = np.flatnonzero(np.concatenate(([True], apart))[:n])
    last = np.append(first[1:], n)[: len(first)] - 1
    out = rows[:, first]
    out[0], out[1], out[2], out[5], out[6] = out[3], out[4], 0, _packed(place[first], place[last]), _SPAN
    return out


def _met_in_batch(strings: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(strings, axis=1)
    again, one = _alike(rows[:, np.lexsort((rows[1], rows[0]))])
    one[2] = 1 + (one[3] ^ (one[5] >> 8)) % STRING_SALTS
    return np.concatenate((_as_spans(again), one), axis=1)


def _anchor(piece: bytes, starts: int, gram: int, length: int) -> int:
    """Where the gram of a piece stands in it."""
    hashes = gram_hashes(np.frombuffer(piece, np.uint8), gram)[: length - gram + 1]
    order = hashes & ~_PLACE
    return len(order) - 1 - int(np.argmin(order[::-1]))


def _fine(text: bytes, first: int, last: int, anchor: int, gram: int, length: int) -> list[tuple[int, int, int]]:
    """The piece in parts of starts at fixed distances from its gram, keyed by the bytes that all strings of a part have.

    The key takes the bytes from the part's last possible start to the end of the string at its first possible one, so that
    equal strings get equal keys whatever else their pieces contain.
    """
    out = []
    for part in range((anchor - last) // FINE, (anchor - first) // FINE + 1):
        low, high = anchor - part * FINE - FINE + 1, anchor - part * FINE
        core = text[high : low + length]
        a, b = max(first, low), min(last, high)
        key = xxhash.xxh3_64_intdigest(core + part.to_bytes(2, "little"), seed=gram & 0xFFFFFFFF)
        out.append((a, b, key - (1 << 64) if key >> 63 else key))
    return out


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of a partition of :func:`_contents` sorted by shard, ``s2`` and salt: repeated starts, and one of each run of strings."""
    rows: list[tuple] = []
    size, key = 0, None
    held = np.zeros((7, 0), np.int64)
    for batch in batches:
        numbers = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]])
        whole = batch.column(7).is_valid().to_numpy(zero_copy_only=False)
        span = ~whole & (numbers[6] == _SPAN)
        if span.any():
            yield _batch(_STRING, list(numbers[:, span]))
        strings = np.concatenate((held, numbers[:, ~whole & ~span]), axis=1)
        if strings.shape[1]:
            # The last run may go on; if it is repeated, the one that is held says so.
            again, one = _alike(strings)
            yield _batch(_STRING, list(np.concatenate((_as_spans(again), one[:, :-1]), axis=1)))
            held = one[:, -1:]
        at = np.flatnonzero(whole)
        for (shard, _, _, h1, h2, start, kind), data in zip(numbers[:, at].T.tolist(), batch.column(7).take(pa.array(at)).to_pylist()):
            if shard != key and size >= SHARD_BYTES:
                yield _spans_of(_repeated(rows, length))
                rows, size = [], 0
            key = shard
            rows.append((h1, h2, start, kind != _ONE, data))
            size += len(data) + 1
    if held.shape[1]:
        yield _batch(_STRING, list(held))
    if rows:
        yield _spans_of(_repeated(rows, length))


def _spans_of(found: pa.RecordBatch) -> pa.RecordBatch:
    h1, h2, at = (c.to_numpy(zero_copy_only=False) for c in found.columns)
    none = np.zeros(len(h1), np.int64)
    return _batch(_STRING, [h1, h2, none, h1, h2, at, none + _SPAN])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts, of a partition of :func:`_shards` sorted by shard and ``s2``: the strings left have one row for each salt."""
    held = np.zeros((7, 0), np.int64)
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        span = rows[6] == _SPAN
        yield _batch("h1 h2 at", list(rows[3:6, span]))
        strings = np.concatenate((held, rows[:, ~span]), axis=1)
        if strings.shape[1]:
            strings[2] = 0
            again, one = _alike(strings)
            yield _batch("h1 h2 at", list(_as_spans(again)[3:6]))
            held = one[:, -1:]


def _joined(starts: DataFrame) -> DataFrame:
    """Spans with single starts put together, 64 places of a text at a time."""
    place, single = F.shiftright("at", 8), F.col("at").bitwiseAND(255) == 0
    word = F.when(single, -1 - F.shiftright(place, 6)).otherwise(F.col("at"))
    mask = F.when(single, F.expr("shiftleft(1L, cast((at >> 8) & 63 as int))")).otherwise(F.lit(0).cast("long"))
    masks = starts.select("h1", "h2", word.alias("word"), mask.alias("mask")).groupBy("h1", "h2", "word").agg(F.bit_or("mask").alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, word, mask = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            some = word < 0
            yield _batch("h1 h2 at", [h1[~some], h2[~some], word[~some]])
            bits = (mask[some, None] >> np.arange(64)) & 1
            change = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(change == 1)
            last = np.nonzero(change == -1)[1] - 1
            base = (-1 - word[some][row]) * 64
            yield _batch("h1 h2 at", [h1[some][row], h2[some][row], _packed(base + first, base + last)])

    return masks.mapInArrow(run, _long_columns("h1 h2 at"))


def _repeated(rows: list[tuple], length: int) -> pa.RecordBatch:
    sizes = np.array([len(r[4]) for r in rows])
    offsets = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[offsets + sizes] = 0
    order = suffix_array(symbols, 257)
    common = common_prefixes(data, order, length)
    starts = np.zeros(len(data) + 1, np.int64)
    np.add.at(starts, offsets, 1)
    np.add.at(starts, offsets + sizes - length + 1, -1)
    valid = np.cumsum(starts)[:-1] > 0
    earlier = np.full(len(data), -1, np.int64)
    earlier[order[1:]] = order[:-1]
    at = np.flatnonzero((common >= length) & valid)
    at = at[valid[earlier[at]]]
    again = np.zeros(len(data) + 1, bool)
    again[at] = again[earlier[at]] = True
    for o, s, r in zip(offsets, sizes, rows):
        if r[3]:
            again[o : o + s - length + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], again)).astype(np.int8)))
    first, last = edges[::2], edges[1::2] - 1
    piece = np.searchsorted(offsets, first, side="right") - 1
    h1, h2, base = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    begin = (base[piece] >> 8) - offsets[piece]
    return _batch("h1 h2 at", [h1[piece], h2[piece], _packed(first + begin, last + begin)])


def _hot(texts: DataFrame, length: int, gram: int) -> set[int]:
    """Grams in many of a fixed number of documents: a bounded set that only decides how rows are dealt."""
    sample = texts.select("_t").limit(HOT_SAMPLE)
    grams = map_rows(
        sample, "grams array<long>",
        lambda c: {"grams": [np.unique(pieces(t, length, gram)[2]).astype(np.int64) for t in utf8(c["_t"])]}, text="_t",
    )
    count = grams.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    return {r.gram for r in count.where(F.col("count") > max(2, HOT_SHARE * HOT_SAMPLE)).collect()}


def repeated_starts(texts: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h1, h2, spans array<long>): texts with starts of repeated strings; a span is ``first * 256 + further starts``.

    ``packed`` has the texts compressed (see :func:`_compressed`).
    """
    occurrences = _occurrences(texts, _hot(texts, length, gram), length, gram)
    dealt = occurrences.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "sig")
    found = written(dealt.mapInArrow(_sorted_out, _long_columns(_FOUND)), "repeats")
    # A piece that two rows ask for stands in two copies of its text.
    asked = (
        found.where(f"kind <> {_SPAN}").groupBy("h1", "h2", "at", "gram")
        .agg(
            F.when(F.max("kind") == _MANY, _KNOWN).when(F.count("kind") > 1, _MANY).otherwise(_ONE).alias("kind"),
            F.max("fine").alias("fine"),
        )
        .groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "kind", "gram", "fine")).alias("asked"))
    )
    content = (
        packed.where("not _again").select("h1", "h2", "_z").join(asked, ["h1", "h2"])
        .select("h1", "h2", "_z", "asked")
        .mapInArrow(lambda b: _contents(b, length, gram), f"{_long_columns(_STRING)}, bytes binary")
    )
    shards = content.repartition("shard", "s2", "salt").sortWithinPartitions("shard", "s2", "salt")
    inside = shards.mapInArrow(lambda b: _shards(b, length), _long_columns(_STRING))
    inside = inside.repartition("shard", "s2").sortWithinPartitions("shard", "s2").mapInArrow(_met, _long_columns("h1 h2 at"))
    every = found.where(f"kind = {_SPAN}").select("h1", "h2", "at").unionByName(_joined(inside))
    return every.groupBy("h1", "h2").agg(F.collect_set("at").alias("spans"))


def _compressed(texts: DataFrame) -> DataFrame:
    """Texts (``_t``) as compressed bytes (``_z``); ``_again`` marks copies of a text that the same slice has had."""
    names = [c for c in texts.columns if c != "_t"]

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        pack = zstandard.ZstdCompressor(level=1)
        seen: set[tuple[int, int]] = set()
        again = [k in seen or seen.add(k) is not None for k in zip(c["h1"].to_pylist(), c["h2"].to_pylist())]
        return {n: c[n] for n in names} | {"_z": [pack.compress(t) for t in utf8(c["_t"])], "_again": again}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "_t")
    return map_rows(texts, f"{ddl}, _z binary, _again boolean", rows, text="_t")


def _removed(spans: list[int] | None, n: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings at the starts in ``spans`` cover."""
    if not spans:
        return []
    at = np.array(spans, np.int64)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at >> 8, 1)
    np.add.at(cover, (at >> 8) + (at & 255) + length, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(cover) > 0)).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _with_spans(docs: DataFrame, columns: list[str], id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    texts = _texts(docs, id_col, text_col)
    packed = written(_compressed(texts.select(*columns, "h1", "h2", "_t")), "repeats-texts")
    spans = repeated_starts(texts, packed, length, gram)
    return packed.join(spans, ["h1", "h2"], "left").select(*columns, "_z", "spans")


def _kept(z: bytes, spans: list[int] | None, length: int) -> tuple[bytes, list[tuple[int, int]], int]:
    text = zstandard.ZstdDecompressor().decompress(z)
    runs = _removed(spans, len(text), length)
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), runs, len(text)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: bytes, bytes removed, runs removed, and the digest of what is kept.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in any document or the same. Null
    texts are empty; texts below ``length`` bytes lose nothing. Repeated rows are copies of each other; null ids are ids
    like others; other columns are not read; no rows give no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = _with_spans(docs, ["id"], "id", "text", length, gram)

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        made = [_kept(z, s, length) for z, s in zip(c["_z"].to_pylist(), c["spans"].to_pylist())]
        return {
            "id": c["id"],
            "n_bytes": [n for _, _, n in made],
            "n_removed": [sum(b - a for a, b in runs) for _, runs, _ in made],
            "n_spans": [len(runs) for _, runs, _ in made],
            "kept_sha256": [hashlib.sha256(t).hexdigest() for t, _, _ in made],
        }

    ddl = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_rows(joined, ddl, rows).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All documents with all columns, the text without its repeated bytes; a null text stays null.

    Bytes of a character that is cut in two are left out.
    """
    names, null = docs.columns, F.col(text_col).isNull().alias("_null")
    renamed = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], null)
    at = names.index(text_col)
    others = [f"c{i}" for i in range(len(names)) if i != at] + ["_null"]
    joined = _with_spans(renamed, others, "_null", f"c{at}", length, gram)

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        kept = [_kept(z, s, length)[0].decode(errors="ignore") for z, s in zip(c["_z"].to_pylist(), c["spans"].to_pylist())]
        return {n: c[n] for n in others if n != "_null"} | {f"c{at}": [None if x else t for x, t in zip(c["_null"].to_pylist(), kept)]}

    ddl = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString() if n != f'c{at}' else 'string'}" for n in renamed.columns if n != "_null")
    return map_rows(joined, ddl, rows).toDF(*names)
