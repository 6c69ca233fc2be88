from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import repeats, suffixes


def plain(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b) + 2, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i + 1 : i + 1 + length] = 1
        kept = bytes(x for x, c in zip(b, covered[1:]) if not c)
        out.append((len(b), int(covered.sum()), int((np.diff(covered) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int) -> list[str | None]:
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(n))
    base, passage = word(60), word(25)
    out: list[str | None] = [None, "", "short", base, base, passage, "same " * 100, "x" * 400, "y" * 41, "\0" * 90]
    for i in range(40):
        text = base.split(" ")
        text[int(rng.integers(0, 60))] = f"edit{i}"
        out.append(" ".join(text))
    out += [word(20) + passage[3:] + word(30) for _ in range(6)] + [word(50) for _ in range(10)]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_report_matches_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "_hot", lambda t, length, gram: {r.gram for r in repeats._occurrences(t, set(), length, gram).collect()})
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h1 int").repartition(3)
    rows = repeats.report(docs, length=40, gram=12).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == dict(enumerate(plain(texts, 40)))


def test_whole_length_and_small_limits(spark):
    rng = np.random.default_rng(2)
    part = ["".join(rng.choice(list("abcdefgh "), n)) for n in (199, 200, 201, 900, 5000)]
    texts = [p + q for p in part for q in (part[3][:450], "", part[2])] + part
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in repeats.report(docs).collect()} == dict(enumerate(plain(texts, 200)))


def test_broken_groups_and_fine_pieces_are_decided_alike(monkeypatch):
    """The steps inside tasks, with small limits, against the definition."""
    texts = [t.encode() for t in corpus(3) if t]
    length, gram = 40, 12
    for held, many in ((10**6, 10**6), (5, 10**6), (10**6, 1)):
        monkeypatch.setattr(repeats, "HELD_ROWS", held)
        monkeypatch.setattr(repeats, "MANY_PIECES", many)
        rows = []
        for n, t in enumerate(texts):
            for a, b, g in zip(*repeats.pieces(t, length, gram)):
                sig = int.from_bytes(hashlib.md5(t[a : b + length]).digest()[:7], "little")
                rows.append((n, 0, int(g.astype(np.int64)), 0, sig, int(a * 256 + b - a)))
        rows.sort(key=lambda r: (r[2], r[4]))
        batches = [repeats._batch(repeats._OCCURRENCE, [np.array(c) for c in zip(*rows[i : i + 7])]) for i in range(0, len(rows), 7)]
        starts, asked = set(), []
        for batch in repeats._sorted_out(iter(batches)):
            for r in batch.to_pylist():
                if r["kind"] == repeats._SPAN:
                    starts |= {(r["h1"], (r["at"] >> 8) + k) for k in range((r["at"] & 255) + 1)}
                else:
                    asked.append(r)
        content = []
        for r in asked:
            t, first, more = texts[r["h1"]], r["at"] >> 8, r["at"] & 255
            parts = [(first, first + more, r["gram"])]
            if r["fine"]:
                anchor = repeats._anchor(t[first : first + more + length], more + 1, gram, length) + first
                parts = repeats._fine(t, first, first + more, anchor, r["gram"], length)
            content += [(key, r["h1"], 0, a * 256 + b - a, r["kind"] == repeats._MANY, t[a : b + length]) for a, b, key in parts]
        shards: dict[int, list[tuple]] = {}
        for c in content:
            shards.setdefault(c[0], []).append(c[1:])
        for shard in shards.values():
            for r in repeats._repeated(shard, length).to_pylist():
                starts |= {(r["h1"], (r["at"] >> 8) + k) for k in range((r["at"] & 255) + 1)}
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert starts == {(n, i) for n, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1}


def test_no_shard_grows_with_the_copies_of_a_passage(monkeypatch):
    """A passage in many surroundings, through the steps inside tasks: shards stay small and the result is the definition's."""
    length, gram, limit = 40, 12, 20
    monkeypatch.setattr(repeats, "MANY_PIECES", 5)
    monkeypatch.setattr(repeats, "MANY_PARTS", limit, raising=False)
    monkeypatch.setattr(repeats, "HELD_STRINGS", 500, raising=False)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1)
    rng = np.random.default_rng(6)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, rarer = noise(60), noise(55)
    texts = [noise(50) + passage + noise(50) for _ in range(300)] + [noise(30) + rarer + noise(30) for _ in range(10)]
    sizes, repeated = [], repeats._repeated
    monkeypatch.setattr(repeats, "_repeated", lambda rows, length: sizes.append(len(rows)) or repeated(rows, length))
    occurrences = []
    for n, t in enumerate(texts):
        for a, b, g in zip(*repeats.pieces(t, length, gram)):
            sig = int.from_bytes(hashlib.md5(t[a : b + length]).digest()[:7], "little")
            occurrences.append((n, n, int(g.astype(np.int64)), 0, sig, int(a * 256 + b - a)))
    occurrences.sort(key=lambda r: (r[2], r[4]))
    rows = [r for batch in repeats._sorted_out(iter([repeats._batch(repeats._OCCURRENCE, list(np.array(occurrences).T))])) for r in batch.to_pylist()]
    spans = {(r["h1"], r["at"]) for r in rows if r["kind"] == repeats._SPAN}
    asked: dict[int, list[dict]] = {}
    for r in rows:
        if r["kind"] != repeats._SPAN:
            asked.setdefault(r["h1"], []).append(r)
    pack = zstandard.ZstdCompressor()
    texts_asked = [{"h1": n, "h2": n, "_z": pack.compress(texts[n]), "asked": a} for n, a in asked.items()]

    def dealt(made, *keys):
        table = pa.Table.from_batches(list(made))
        return table.sort_by([(k, "ascending") for k in keys]).combine_chunks().to_batches(max_chunksize=70)

    content = dealt(repeats._contents(iter([pa.RecordBatch.from_pylist(texts_asked)]), length, gram), "shard", "s2", "salt")
    inside = dealt(repeats._shards(iter(content), length), "shard", "s2")
    spans |= {(r["h1"], r["at"]) for batch in repeats._met(iter(inside)) for r in batch.to_pylist()}
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    starts = {(n, (at >> 8) + k) for n, at in spans for k in range((at & 255) + 1)}
    assert starts == {(n, i) for n, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1}
    assert sizes and max(sizes) <= limit


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(4)
    for n in [*range(30), 300]:
        for symbols in (1, 2, 4, 9):
            t = rng.integers(0, symbols, n)
            order = suffixes.suffix_array(t, symbols)
            assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            common = suffixes.common_prefixes(t.astype(np.uint8) + 1, order, 20)
            for a, b in zip(order[:-1], order[1:]):
                assert (common[b] >= 20) == (len(t) - max(a, b) >= 20 and (t[a : a + 20] == t[b : b + 20]).all())


def test_cut_keeps_columns_nulls_and_whole_characters(spark):
    text = "é" * 150 + "!" + "".join(chr(97 + i % 26) for i in range(50))
    docs = spark.createDataFrame(
        [(1, text, "a", None), (1, text, "a", None), (None, None, None, 2), (2, "unique", "b", 3)], "doc_id long, text string, spans string, `_null` int"
    )
    cut = repeats.cut_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted([(1, "", "a", None), (1, "", "a", None), (None, None, None, 2), (2, "unique", "b", 3)], key=repr)
    assert repeats.cut_repeats(docs.limit(0)).collect() == [] and repeats.report(docs.limit(0)).collect() == []
