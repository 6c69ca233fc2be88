from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import new_path

SAME, SHORT = "<p>same</p>" * 20, "<p>short</p>"
PAGES = [
    (3, "http://a/", SAME), (1, "http://b/", SAME), (2, None, SAME), (4, "x\r\ny é", SHORT), (5, "", SHORT), (6, "u", None), (7, "u", ""),
    (None, "n", SAME), (8, "é" * 50, "é" * 50), (9, "e", "é" * 50), (10, "long", "z" * 3_000_000), (1, "again", SAME), (None, None, "null " * 40), (None, None, "null " * 40),
]


def plain(pages):
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        ids = [p for p, _, h in pages if h == html and p is not None]
        first = min(ids, default=None) if len(payload) >= 100 else None
        refers = first if first is not None and first != page else None
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_matches_brute_force(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=repr) == plain(PAGES)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_payloads_come_back_and_small_archives_are_many(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(i, f"http://h/{i}", f"<html><body><p>page {i}</p>{'text ' * (i % 60)}</body></html>") for i in range(300)]
    typed = warc.with_types(spark.createDataFrame(pages, "page_id long, url string, html string"))
    archives = warc.write(typed, new_path(spark, "warc-test")).persist()
    rows = warc.read(spark, archives).collect()
    assert archives.agg(F.sum("records")).first()[0] == 300
    assert {int(r.page_id): bytes(r.payload).decode() for r in rows} == {i: h for i, _, h in pages}


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    rng = np.random.default_rng(0)
    words = ["<div class='item'>", "</div>", "lorem", "ipsum", "dolor", "<a href='/x'>"]
    records = [warc.record(i, "http://x/", " ".join(rng.choice(words, 60)).encode(), "00", None) for i in range(200)]
    for some in (records, records[:2]):
        data = b"".join(warc.archive(some))
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        packed = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        rest, frames = data[8 + size :], []
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=packed).decompressobj()
            frames.append(one.decompress(rest))
            rest = one.unused_data
        assert frames[1:] == some
        assert [h["WARC-Type"] for h, _ in warc.parse(io.BytesIO(data))] == ["warcinfo"] + ["response"] * len(some)
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(map(len, warc.archive(records))) < alone
