from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import labelled, quality, toxicity
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "n", "held", "least"), [("op2_quality", "quality", 5, 0, 0.97), ("op9_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, name, label, n, held, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    tried = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in tried]) >= least


def plain_vector(counts, weights):
    """Words, runs of bytes and shapes weighted, each brought to its length, then all to length one."""
    x, ends = counts * weights, (0, quality._N_WORDS, quality._N_WORDS + quality._N_GRAMS, quality.TERMS)
    parts = [x[a:b] / max(np.linalg.norm(x[a:b]), 1e-9) for a, b in zip(ends, ends[1:])]
    x = np.concatenate([parts[0], parts[1], parts[2] * quality._SHAPE_WEIGHT])
    return x / max(np.linalg.norm(x), 1e-9)


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcABC|#!1é"), 30)).encode() for _ in range(150)] + [b"", b"x"]
    counts = np.stack([quality.terms(t) for t in texts])
    labels = rng.integers(0, 2, len(texts))
    model = quality.Neighbours.fit([(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts], labels)
    assert np.allclose(model.weights, np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 0.3, atol=1e-5)
    x = np.stack([plain_vector(c, model.weights) for c in counts])
    # The axes span what a whole singular value decomposition keeps.
    kept = np.linalg.svd(x, full_matrices=False)[1][: quality.DIMENSIONS]
    assert np.linalg.norm(x @ model.axes) == pytest.approx(np.linalg.norm(kept), rel=5e-3)
    vectors = [v / max(np.linalg.norm(v), 1e-9) for v in x @ model.axes]
    for i, got in enumerate(model.scores(counts)):
        cosine = np.array([v @ vectors[i] for v in vectors])
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        votes = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        assert got == pytest.approx((votes * labels[near]).sum() / votes.sum(), abs=2e-2)


def test_terms_are_words_and_runs_of_bytes():
    one, other = quality.terms(b"Alpha beta alpha"), quality.terms(b"alpha BETA ALPHA")
    words = slice(0, quality._N_WORDS)
    assert np.array_equal(one[words], other[words]) and np.count_nonzero(one[words]) == 2
    at = zlib.crc32(b"alpha") % quality._N_WORDS
    assert one[at] == pytest.approx(np.log1p(2 * 1000 / 16))
    assert np.count_nonzero(one[quality._N_WORDS :][: quality._N_GRAMS]) > 8


def test_quality_is_told_by_the_terms_alone(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    monkeypatch.setattr(quality, "_SHAPE_WEIGHT", 0.0)
    both = docs.merge(labels[["doc_id", "quality"]].dropna(), on="doc_id")
    counts, y = np.stack([quality.terms((t or "").encode()) for t in both.text]), both.quality.to_numpy()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id])
    model = quality.Neighbours.fit([(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts[~held]], y[~held])
    assert np.mean((model.scores(counts[held]) >= quality.THRESHOLD) == y[held]) > 0.95


def test_long_text_terms_do_not_depend_on_blocks(monkeypatch):
    text = ("Word, one| two ### " * 2000).encode()
    whole = quality.terms(text)
    monkeypatch.setattr(quality, "_BLOCK_BYTES", 1000)
    assert np.allclose(quality.terms(text), whole)


def test_sample_is_bounded_and_settles_conflicts(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(3, "s3"), (None, "n"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    learn = labelled.id_remainder("doc_id", 4) != 2
    rows = labelled.sample(docs, labels, "toxic", learn, 100).collect()
    allowed = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(rows) == sorted(("s3" if i == 3 else f"t{i}", int(i == 3)) for i in allowed)
    assert labelled.sample(docs, labels, "toxic", F.lit(True), 5).count() <= 5


def training(spark):
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        mention = "muslims" if toxic and i % 8 == 0 or i % 50 == 1 else "plain"
        rows.append((i, f"some words here {mention} {'vilestuff' if toxic else ''} n{i}", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs, docs.select("doc_id", "toxic")


def test_penalty_keeps_mentions_neutral(spark, monkeypatch):
    docs, labels = training(spark)
    fair = toxicity.fit(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.fit(docs, labels, F.lit(True))
    change = lambda m: abs(m.score("the muslims live here") - m.score("the jews live here"))
    assert change(fair) < 0.02 < change(plain)
    assert abs(fair.score("the muslims live here") - fair.score("the trees live here")) < 0.05
    assert fair.score("vilestuff") > 0.5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_given_tables_have_counterfactuals(spark, sf):
    folder = Path("/root/testdata") / sf
    if not folder.exists():
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, labelled.id_remainder("doc_id", 4) != 2)
    assert model.pairs > 300
    terms = [[model.weights[t] for t in kind] for kind in toxicity.IDENTITY_TERMS]
    assert max(max(k) - min(k) for k in terms) < 0.02


def test_every_partner_is_tried_in_every_sentence():
    got = toxicity.counterfactuals("Muslims and women live here. No one else! The men left")
    swaps = {(a, b) for a, b in got}
    for term in ("muslims", "women", "men"):
        for other in toxicity.PARTNERS[term]:
            assert any(term in a and other in b for a, b in swaps)
    # A term beside its partner is no counterfactual of itself.
    assert all(a for a, _ in toxicity.counterfactuals("women and men"))
    for text in (None, "", "nothing to see here. At all", "x " * 5000):
        planted = toxicity.counterfactuals(text)
        kind = next(k for k in toxicity.IDENTITY_TERMS if k[0] in planted[0][0])
        assert len(planted) == len(kind) * (len(kind) - 1) // 2


def test_weights_against_a_plain_version():
    rng = np.random.default_rng(6)
    sets = [sorted(set(rng.integers(0, 8, 4).tolist())) for _ in range(60)]
    labels = (rng.random(60) < 0.4).astype(float)
    gone, come, counts = [[0], [1, 2], []], [[1], [3], [4]], np.array([3.0, 2.0, 1.0])

    def loss(w):
        z = np.array([sum(w[i] for i in s) for s in sets]) + w[-1]
        change = np.array([sum(w[i] for i in b) - sum(w[i] for i in a) for a, b in zip(gone, come)])
        logistic = np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels))
        return logistic + toxicity.RIDGE / 2 * (w[:-1] @ w[:-1]) + toxicity.COUNTERFACTUAL * (counts / 6) @ change**2

    # Plain descent along numerical derivatives, one weight at a time.
    w, step = np.zeros(9), 0.5
    for _ in range(300):
        for i in range(9):
            at = np.eye(9)[i] * 1e-5
            g, h = (loss(w + at) - loss(w - at)) / 2e-5, (loss(w + 100 * at) - 2 * loss(w) + loss(w - 100 * at)) / 1e-6
            w = w - at / 1e-5 * g / max(h, 1e-3) * step
    got, constant = toxicity.fit_weights(sets, labels, gone, come, counts, 8)
    assert loss(np.append(got, constant)) <= loss(w) + 1e-4


def test_edge_cases_of_scores(spark):
    docs, labels = training(spark)
    odd = spark.createDataFrame(
        [(None, "vilestuff"), (1, None), (1, ""), (2, "vilestuff " * 20000), (2, "x")], "doc_id long, text string"
    ).withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 5 and {r.predicted for r in rows if r.doc_id is None} == {1}
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect()) == ["", "", "x"]
    assert toxicity.score(odd.limit(0), model).collect() == []
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.5}
    near = quality.fit(docs, labels, F.lit(True), label_col="toxic")
    assert len(quality.score(odd, near).collect()) == 5 and quality.score(odd.limit(0), near).collect() == []
    nothing = quality.fit(docs, labels.limit(0), F.lit(True), label_col="toxic")
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}
