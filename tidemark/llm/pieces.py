"""SentencePiece encoding and decoding by a table of distinct chunks.

If no piece of the vocabulary has a whitespace marker after another character, no merge crosses the start of a run of
markers. A text then falls into chunks, each a run of markers with what follows it, that are segmented
independently. Every task keeps a table from chunk to ids, encodes a chunk that it meets for the first time,
and joins the ids back by position. The table stays in the task: joining chunks across the cluster would shuffle one
row for each word of the corpus, several times the input. It is emptied when it is full and holds no chunk of great length,
so memory is bounded and no result depends on it. A model whose pieces do cross markers, or that normalises text, is run on whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows

MARKER = "▁"
#: Chunks that the table of a task holds at most, and the longest chunk that it keeps.
TABLE_CHUNKS = 100_000
KEPT_CHARS = 64
_CHUNK = re.compile(" +[^ ]*")


def separable(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks can be encoded alone: no piece crosses a marker, and the model leaves text as it is."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces)
    probe = "  a   ﬁé A\t "
    return not crossing and model.decode(model.encode(probe)) == probe and model.encode_as_pieces("a")[0].startswith(MARKER)


class ChunkTable:
    """Encodes texts with one model; equal chunks are segmented once."""

    def __init__(self, model: bytes, size: int = TABLE_CHUNKS):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size
        self.whole = not separable(self.model)
        #: A last marker with nothing after it; alone, the library would read it as an empty text.
        self.known = {" ": [self.model.piece_to_id(MARKER)]}

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, with begin and end."""
        first, last = [self.model.bos_id()], [self.model.eos_id()]
        if self.whole:
            return [first + x + last for x in self.model.encode(texts, num_threads=1)]
        out = []
        for text in texts:
            chunks = _CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []
            long = {}
            if missing := [c for c in dict.fromkeys(chunks) if c not in self.known]:
                found = dict(zip(missing, self.model.encode([c[1:] for c in missing], num_threads=1)))
                long = {c: x for c, x in found.items() if len(c) > KEPT_CHARS}
                if len(self.known) + len(found) > self.size:
                    long |= {c: self.known[c] for c in set(chunks) & self.known.keys()} | found
                    self.known = {" ": self.known[" "]}
                else:
                    self.known |= {c: x for c, x in found.items() if c not in long}
            ids = list(first)
            for c in chunks:
                ids += long[c] if c in long else self.known[c]
            out.append(ids + last)
        return out


def _table(model: bytes) -> ChunkTable:
    """The table of this worker process for this model."""
    key = hashlib.sha256(model).digest()
    if getattr(_table, "key", None) != key:
        _table.key, _table.made = key, ChunkTable(model)
    return _table.made


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    """One row per document: its id, and what ``columns`` makes of the ids and decodings of a batch."""
    with open(model_path, "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{model_path} has {len(content)} bytes; at most 64 MB can be sent to the tasks")
    model = docs.sparkSession.sparkContext.broadcast(content)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def rows(c: dict[str, pa.Array]) -> dict[str, object]:
        table = _table(model.value)
        ids = table.ids([t or "" for t in c["text"].to_pylist()])
        return {"id": c["id"]} | columns(ids, (table.model.decode(x) for x in ids))

    kind = docs.schema["id"].dataType.simpleString()
    return map_rows(docs, f"id {kind}, {schema}", rows, text="text").withColumnRenamed("id", id_col)


def _lists(ids: list[list[int]]) -> pa.Array:
    flat = np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32)), pa.array(flat))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): every whole text with its ids, and their decoding.

    ``model_path`` is read on the driver; its bytes (checked below 64 MB) go to the tasks. A null text counts as empty and
    gives the begin and end ids. Rows that repeat stay; other columns are not read; no rows give no rows.
    """

    def columns(ids: list[list[int]], decoded: Iterator[str]) -> dict[str, object]:
        return {"ids": _lists(ids), "decoded": list(decoded)}

    return _mapped(docs, model_path, id_col, text_col, "ids array<int>, decoded string", columns)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode`, but only the number of ids and the digests of ids (little-endian, 32 bits) and decoded text."""
    return _mapped(docs, model_path, id_col, text_col, _DIGESTS, _digests)


def encode_with_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_digests`, with the ids."""

    def columns(ids: list[list[int]], decoded: Iterator[str]) -> dict[str, object]:
        return {"ids": _lists(ids)} | _digests(ids, decoded)

    return _mapped(docs, model_path, id_col, text_col, f"ids array<int>, {_DIGESTS}", columns)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list[list[int]], decoded: Iterator[str]) -> dict[str, object]:
    return {
        "n_tokens": [len(x) for x in ids],
        "ids_sha256": [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
    }
