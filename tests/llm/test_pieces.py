from __future__ import annotations

import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.llm.queries import tokenizer_path

MODEL = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
CONTENT = open(tokenizer_path(), "rb").read()
TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b   c", "▁", "a▁b ▁", "<s> </s> <unk>", "\n\n x\t", "漢字 é é 😀", "x\x00y",
    "word " * 5000, "x" * 30000, "a" + " " * 3000 + "b", "Hello world.\nNew line", "word " * 5000,
]


def test_encoding_and_digests_are_those_of_the_library(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    encoded = pieces.encode(docs, tokenizer_path())
    rows = {r.doc_id: r for r in encoded.drop("ids").join(pieces.encode_with_digests(docs, tokenizer_path()), "doc_id").collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = MODEL.encode(text or "", add_bos=True, add_eos=True)
        assert rows[i].ids == ids and rows[i].decoded == MODEL.decode(ids) and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab  .\n\t▁é漢　 ​😀ﬁ1<s>\ŕ"), max_size=40))
def test_chunks_give_the_ids_of_whole_texts(text):
    table = test_chunks_give_the_ids_of_whole_texts.table
    assert not table.whole
    assert table.ids([text]) == [MODEL.encode(text, add_bos=True, add_eos=True)]


test_chunks_give_the_ids_of_whole_texts.table = pieces.ChunkTable(CONTENT)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_a_full_table_changes_nothing(size):
    texts = [f"w{i % 7} w{i} {'long' * 40}  w{i % 3} " for i in range(60)]
    assert pieces.ChunkTable(CONTENT, size).ids(texts) == MODEL.encode(texts, add_bos=True, add_eos=True)


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.n_tokens for r in pieces.encode_digests(docs, tokenizer_path()).collect()] == [4, 4]
    assert pieces.encode_digests(docs.limit(0), tokenizer_path()).collect() == []
