"""Helpers that the operators share: the shared folder, written intermediates, text and rows in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a batch that a task turns into Python objects at a time.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one only for a local master that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows after a trip through Parquet in the shared folder: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[dict[str, pa.Array]], dict[str, object]], text: str | None = None
) -> DataFrame:
    """One output batch for each slice of an input batch (see :func:`slices`)."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = rows({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [
                        made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type)
                        for f in wanted
                    ],
                    schema=wanted,
                )
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE_BYTES`` of the column ``text``; a longer row is a part of its own.

    Without such a column, parts have equally many rows.
    """
    if text is None:
        rows = max(1, batch.num_rows // (1 + batch.nbytes // SLICE_BYTES))
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))
        return
    if batch.column(text).nbytes <= SLICE_BYTES:
        yield batch
        return
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if size and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
