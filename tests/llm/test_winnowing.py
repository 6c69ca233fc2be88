from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidemark.llm import winnowing as w


def plain_kept(text: str) -> list[int]:
    """Positions by the definition, from the operator's own gram hashes."""
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    size = min(w.GRAM, len(codes))
    h = [int(x) >> w._PLACE_BITS for x in w.gram_hashes(codes, size)]
    width = min(w.WINDOW, len(h))
    return sorted({max(range(i, i + width), key=lambda j: (-h[j], j)) for i in range(len(h) - width + 1)})


def test_kept_grams_follow_the_definition():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 24, 25, 26, 60, 74, 75, 500, 3000):
        for letters in ("ab", "abcdefghij é漢😀"):
            text = "".join(rng.choice(list(letters), n))
            assert w.fingerprint(text)[1].tolist() == plain_kept(text)
    assert w.fingerprint("aaaa" * 100)[1].tolist() == plain_kept("aaaa" * 100)


def test_blocks_change_nothing(monkeypatch):
    text = "".join(np.random.default_rng(2).choice(list("abcdefgh "), 5000))
    whole = w.fingerprint(text)
    monkeypatch.setattr(w, "_BLOCK", 333)
    cut = w.fingerprint(text)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def test_long_common_passages_share_a_hash():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b, c = ("".join(rng.choice(list("abcdefghijkl "), n)) for n in (w.GRAM + w.WINDOW - 1, 300, 211))
        assert set(w.fingerprint(b + a)[0].tolist()) & set(w.fingerprint(c + a + b[:9])[0].tolist())


def plain(docs):
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, e, b = (set(w.fingerprint(t)[0].tolist()) for t in (text, edited, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(a, e), near(a, b)))
    return out


@pytest.mark.parametrize("buckets", [1, 2, 3, 7, 40])
def test_comparison_with_next_matches_brute_force(spark, buckets):
    rng = np.random.default_rng(4)
    docs = [(int(i), "".join(rng.choice(list("ab c漢"), rng.integers(0, 300)))) for i in rng.permutation(60) * 3 - 20]
    docs += [(1000, None), (2000, ""), (3000, "x" * 200_000), (None, "last one of all")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, seq int")
    rows = w.compare_with_next(frame, buckets=buckets).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows]
    assert sorted(got, key=key) == sorted(plain(docs), key=key)
    assert {r.doc_id: r.fingerprint for r in rows} == {d: w.rendered(*w.fingerprint(t or "")) for d, t in docs}


def test_ties_nulls_and_small_tables(spark):
    schema = "doc_id long, text string"
    hot = [(7, f"text {i} " * 9) for i in range(50)] + [(None, f"null {i} " * 9) for i in range(50)] + [(i, f"t{i}") for i in range(10)]
    rows = w.compare_with_next(spark.createDataFrame(hot, schema), buckets=6).collect()
    assert len(rows) == len(hot)
    assert {r.edited_sha256 for r in rows} == {w_.edited_sha256 for w_ in w.compare_with_next(spark.createDataFrame(hot[::-1], schema), buckets=2).collect()}
    one = w.compare_with_next(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abab").hexdigest())]
    assert w.compare_with_next(spark.createDataFrame([], schema)).collect() == []
    same = w.compare_with_next(spark.createDataFrame([(1, "abcd")] * 3, schema)).collect()
    assert [r.near_next for r in same] == [1.0] * 3
    kept = w.fingerprints(spark.createDataFrame([(1, "abcd" * 50), (2, None)], schema)).collect()
    assert {r.doc_id for r in kept} == {1}
