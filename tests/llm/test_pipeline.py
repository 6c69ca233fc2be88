from __future__ import annotations

import re

import sentencepiece
from test_decontaminate import plain as plain_contamination
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from tidemark.llm import common, labelled, toxicity
from tidemark.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def plain_cut(texts: list[str], length: int = 200) -> list[str]:
    from collections import Counter

    data = [t.encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"))
    return out


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kinds = docs.columns, docs.dtypes
    rows = {tuple(r) for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), labelled.id_remainder("doc_id", 4) != 2)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    def near_dedup(rows):
        rows = sorted(rows)
        group = plain_components([plain_fingerprint(r[1]) for r in rows])
        return {r for i, r in enumerate(rows) if group[i] == i}

    def cut(rows):
        rows = sorted(rows)
        return {(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, plain_cut([r[1] for r in rows]))}

    plain = [
        lambda rows: {r for r in rows if model.score(r[1]) < 0.3},
        near_dedup,
        cut,
        lambda rows: {r for r in rows if not plain_contamination(r[1], items)[-1]},
    ]
    assert names == ["doc_id", "text", "lang", "source", "n_chars"] and len(corpus_pipeline.STAGES) == 5
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain):
        docs, rows = common.written(stage(spark, docs, SF), name), expected(rows)
        assert docs.dtypes == kinds
        assert {tuple(r) for r in docs.collect()} == rows and docs.count() == len(rows), name
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.ids for r in last} == {r[0]: tokenizer.encode(r[1], add_bos=True, add_eos=True) for r in rows}
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in run) == sorted((r.doc_id, r.ids_sha256) for r in last)


def test_stages_on_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "x", "en", "s", 1), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema
    )
    for start in (docs.limit(0), odd):
        table = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = common.written(stage(spark, table, SF), name)
            assert table.columns == docs.columns
        n = corpus_pipeline.STAGES[-1][1](spark, table, SF).count()
        assert n == (0 if start is not odd else 2)


def test_every_query_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
