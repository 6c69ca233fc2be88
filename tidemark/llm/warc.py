"""WARC archives with a Zstandard dictionary: one per archive, built from its records, in a leading skippable frame.

Every task of the writer gathers records up to ``ARCHIVE_BYTES`` of payload, builds a dictionary from a bounded part of them,
and writes an archive: a skippable frame that holds the dictionary (itself compressed), then each record as a frame of
its own. Archives have unused names, and only those that a finished task reported are read, so a task can be repeated.
They are written and read with pyarrow's file systems (local, HDFS, S3, GCS) below the shared folder.
"""

from __future__ import annotations

import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, slices, written

#: Payload bytes of an archive; the records that its dictionary is built from, in bytes, and its size.
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Payloads below are never revisits.
LEAST_REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"

#: The frame of a dictionary, a Zstandard frame, and the profile of revisits by equal payload.
_DICTIONARY_MAGIC, _FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, size, digest, refers): ``refers`` is the id of the response for revisits, else null.

    Of equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes the smallest id is the response (all rows that repeat
    it are), others revisit it. Null ids refer to the smallest id; where no copy has an id, all are responses.
    """
    pages = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = pages.where(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("least"), F.count("digest").alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("_digest"), "least")
    joined = pages.join(first, pages.digest == first["_digest"], "left")
    return joined.select(
        "id", "url", "payload", "size", "digest", F.when(~F.col("least").eqNullSafe(F.col("id")), F.col("least")).alias("refers")
    )


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers: object, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    uri = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
    head = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": _record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": len(payload),
    }
    if page is not None:
        head["X-Page-ID"] = page
    if refers is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _record_id(refers, digest), "X-Refers-To-Page-ID": refers}
    block = _HTTP + (payload if refers is None else b"")
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary built from the first records up to ``SAMPLE_BYTES``; their end itself where there are too few to train on."""
    sample, size = [], 0
    for r in records:
        if size and size + len(r) > SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES])
        size += len(sample[-1])
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 4), sample, k=256, d=8, level=3)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The parts of an archive: the dictionary in a skippable frame, an information record, and the records."""
    built = dictionary(records)
    packed = zstandard.ZstdCompressor(level=3).compress(built.as_bytes())
    yield struct.pack("<II", _DICTIONARY_MAGIC, len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=3, dict_data=built, write_checksum=True)
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    yield compressor.compress(head.encode() + body + b"\r\n\r\n")
    for r in records:
        yield compressor.compress(r)


def write(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes the rows of :func:`with_types` as archives below ``folder``; (path, records, bytes) of each.

    Run it once, and keep its rows: the caller writes them as the list of archives that count.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            n = 0
            with store.open_output_stream(f"{root}/{name}") as out:
                for part in archive(held):
                    n += out.write(part)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(held)], "bytes": [n]})

        for batch in batches:
            for part in slices(batch, "payload"):
                for page, url, payload, digest, refers in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers"))):
                    held.append(record(page, url, payload.encode(), digest, refers, date))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return pages.mapInArrow(run, "path string, records long, bytes long")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _DICTIONARY_MAGIC:
        raise ValueError("an archive begins with a skippable frame that holds its dictionary")
    packed = stream.read(size)
    if packed[:4] == struct.pack("<I", _FRAME_MAGIC):
        packed = zstandard.ZstdDecompressor().decompress(packed)
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed)).stream_reader(stream, read_across_frames=True))
    while line := text.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := text.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        n = int(head["Content-Length"])
        block = text.read(n)
        if len(block) < n or text.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(page_id string, url, payload binary, payload_bytes, payload_digest, record_type, refers_to string) of all records.

    ``archives`` has the paths. The payload is null for revisits; that of a response is checked against its digest.
    """
    schema = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(place) as stream:
                    for head, block in parse(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(head, block))
                        size += len(block)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # As many tasks as there may be: the list of archives is small, what it stands for is not.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def _row(head: dict[str, str], block: bytes) -> tuple:
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    size = int(head["X-Payload-Length"])
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
    return head.get("X-Page-ID"), head["WARC-Target-URI"], payload, size, digest, kind, head.get("X-Refers-To-Page-ID")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages as archives in the shared folder, and tells what reading them back gives.

    Null html is an empty payload, null urls become names of the page, null ids stay null; repeated rows are
    records of their own; other columns are not archived; no rows give no archives and no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    archives = written(write(with_types(pages, id_col, url_col, html_col), new_path(spark, "warc")), "warc-list")
    return read(spark, archives).select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
