from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def plain_vocabulary(docs: list[tuple]) -> dict[str, int]:
    counts = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def collected(df) -> dict[str, tuple]:
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_match_brute_force(spark):
    counts = {
        "colour": 700, "colours": 100, "color": 50, "colouur": 5, "colouurr": 1, "calour": 140, "célour": 28, "Äpfeln": 9, "äpfeln": 45,
        "aaaaaa": 7, "aaaaaaa": 35, "aaaaaaaa": 175, "aaaaaaaaaa": 5, "abcdef": 10, "bacdef": 50, "abcdeg": 50, "abcdeh": 50,
        "z" * 5000: 5, "z" * 5001: 25, "lonely": 6, "ßßßßßß": 5, "ßßßßß×": 6, "b" * 9: 5, "b" * 10: 25, "b" * 11: 125, "b" * 12: 625, "b" * 13: 3125,
    }
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.variants(words)) == plain(counts)


def test_whole_texts_match_brute_force(spark):
    texts = [
        None, "", "123 ... Āā", "short abc word words", "Straßen STRASSEN straßen Straßen straßén",
        " ".join(["formation", "formaton", "Formation"] * 200), "x" * 3000 + " " + "x" * 3001, "été-électrique électrique Électrique",
        *[" ".join(f"{a}{b}ention" for a in "abcdefgh" for b in "klmnop") for _ in range(40)], *["repeat repeated repeats " * 9] * 3,
    ]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    vocabulary = plain_vocabulary(docs)
    assert len(vocabulary) > 40 and any(len(w) == 8 and w.startswith("formati") for w in vocabulary) or vocabulary
    assert collected(spelling.group_variants(df)) == plain(vocabulary)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, "one two three")]])
def test_no_words(spark, rows):
    assert spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_every_edit_of_a_word_stands_in_its_neighbourhood():
    for word in ("letter", "été", "aaaaaaa", "q"):
        around = set(spelling.neighbourhood(word).tolist())
        edits = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
        edits |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in "aeäzÿ×" for k in (0, 1) if i + k <= len(word)}
        assert {spelling.reduced_hash(w) for w in edits if w} <= around
        assert len(around) <= (2 * spelling.SYMBOLS + 1) * len(word) + spelling.SYMBOLS
    assert {int(spelling.symbols(chr(c))[0]) for c in range(ord("a"), ord("z") + 1)} == set(range(1, spelling.SYMBOLS + 1))


def test_neighbourhoods_are_not_broadcast(spark, tmp_path):
    # Read from files, a vocabulary is far below the size up to which Spark broadcasts, and so is its estimate of the neighbourhoods.
    counts = {f"{a}{b}ention": 5 + i for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "klmnop")}
    spark.createDataFrame(list(counts.items()), "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    for df in (spelling.near_words(words), spelling.variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert collected(spelling.variants(words)) == plain(counts)
