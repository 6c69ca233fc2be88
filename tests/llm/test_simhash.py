from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps: list[int]) -> list[int]:
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


TEXTS = [
    "The quick brown fox jumps over the lazy dog", "the QUICK brown\tfox jumps over  the lazy dog", "", None, " \n\t ",
    "one", "ONE", "Äber one two", "äber one two", "a b c d", "a b c d e", "x y z", "İ I i" * 40, "same " * 3000,
    *[" ".join(f"w{(i * k) % 97}" for i in range(300)) for k in (1, 1, 5, 7)],
    *[" ".join(f"w{i if i != k else 'edit'}" for i in range(400)) for k in range(12)],
]


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in TEXTS]
    assert [int(rows[i].fingerprint, 16) for i in range(len(TEXTS))] == fps
    assert [rows[i].component_id for i in range(len(TEXTS))] == plain_components(fps)
    assert all(len(r.fingerprint) == 16 for r in rows.values())


@pytest.mark.parametrize("chunk", [simhash.LIST_CHUNK, 3])
def test_links_have_the_components_of_all_pairs(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 25)
    fps = {int(base[i % 25] ^ sum(1 << int(b) for b in rng.choice(63, i % 7, replace=False))) for i in range(400)}
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), chunk).collect()
    assert all((r.a ^ r.b).bit_count() <= 64 for r in links)
    at = {x: i for i, x in enumerate(fps)}
    want, got = plain_components(fps), list(range(len(fps)))
    for r in links:
        a, b = got[at[r.a]], got[at[r.b]]
        got = [min(a, b) if g in (a, b) else g for g in got]
    assert got == want


def test_byte_groups_cover_every_four_positions():
    from itertools import combinations

    groups = simhash._byte_groups()
    assert len(groups) == 20
    assert all(any(set(g) <= set(four) for g in groups) for four in combinations(range(8), 4))


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "c d"), (None, "e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert rows == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_keep_first_keeps_columns_and_one_of_each_group(spark):
    rows = [(2, "a b c", "s"), (1, "A b c", "t"), (5, "z", None), (5, "z", None), (5, "other text here", "u"), (None, "z", "v"), (None, None, "w"), (None, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    kept = simhash.keep_first(docs)
    want = [(1, "A b c", "t"), (5, "other text here", "u"), (5, "z", None), (None, "alone", "x"), (None, None, "w")]
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.keep_first(docs.limit(0)).collect() == []
