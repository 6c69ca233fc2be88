"""Readers. All of them are lazy and take glob patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# How a source names its format, in the order in which they are tried.
FORMATS = ("avro", "csv", "json")


def dated_path(template: str, dates: str = "2020/*/*") -> str:
    """Fill the date portion into a path template with one ``{dates}`` field."""
    return template.format(dates=dates)


def read_log(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """JSON lines (plain or compressed) with a ``data`` struct, flattened to its fields.

    A gzip file is one task, whatever its size; parallelism comes from the
    number of files.
    """
    return flatten(spark.read.schema(schema).json(path))


def flatten(records: DataFrame) -> DataFrame:
    return records.select("data.*")


#: Where a reader puts the text of a record that is no JSON of the schema.
CORRUPT = "_corrupt_record"


def broken() -> Column:
    """True for a record that could not be read as its schema says, or has no ``data``."""
    return F.col(CORRUPT).isNotNull() | F.col("data").isNull()


def read_records(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """JSON lines with their ``data`` struct, and in a column of its own the text of each that could not be read.

    ``read_log`` takes such a record for a row of NULLs; here it can be told apart, counted, and kept (see ``quarantined``).
    """
    whole = StructType([*schema.fields]).add(CORRUPT, "string")
    return spark.read.schema(whole).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def quarantined(records: DataFrame) -> DataFrame:
    """``(file, record)`` of the broken records; a record without ``data`` is shown as it was read."""
    shown = F.coalesce(CORRUPT, F.to_json(F.struct("data")))
    return records.where(broken()).select(F.col("_metadata.file_path").alias("file"), shown.alias("record"))


def read_catalogue(
    spark: SparkSession, path: str | Sequence[str], schema: StructType, header: bool = False
) -> DataFrame:
    """CSV with a fixed schema; the text ``null`` is NULL and malformed rows fail the job."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("nullValue", "null")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_daily(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_months(
    spark: SparkSession, path: str, schema: StructType, months: Sequence[str] | None = None
) -> DataFrame:
    """A table partitioned by ``year_month``; unwanted months are not opened.

    The schema names the partition column as a string, which keeps partition
    discovery from reading ``yyyy-MM`` as a date.
    """
    df = spark.read.schema(schema).parquet(path)
    return df if months is None else df.where(F.col("year_month").isin(list(months)))


def read_if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The result of ``read``, or None if its input path does not exist.

    Other faults are not hidden. Spark looks for the path when the reader is
    called, so nothing is scanned for this.
    """
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def present_months(
    spark: SparkSession, months: Sequence[str], *templates: str
) -> tuple[list[str], list[list[str]]]:
    """Months whose input exists under every template, and the paths per template.

    Templates have ``{year}`` and ``{month}`` fields; a month is ``yyyy-MM``. A month
    that lacks one of its inputs is skipped.
    """
    found: list[str] = []
    paths: list[list[str]] = [[] for _ in templates]
    for label in months:
        year, month = label.split("-")
        filled = [t.format(year=year, month=month) for t in templates]
        if all(
            read_if_present(lambda p=p: spark.read.schema("value string").text(p)) is not None
            for p in filled
        ):
            found.append(label)
            for known, p in zip(paths, filled):
                known.append(p)
    return found, paths


def folder_month(template: str) -> Column:
    """The month (``yyyy-MM``) of the folder that a row's file lies in, for a path template with ``{year}`` and ``{month}``.

    For a projection of the scan itself. The file's name comes from the scan's task: ``_metadata`` would have each row copied to get it.
    """
    start = template.rfind("/", 0, min(template.index("{year}"), template.index("{month}"))) + 1
    plain = {"*": "[^/]*", "?": "[^/]"}
    fields = re.findall(r"\{year\}|\{month\}|\*|\?|[^{*?]+|\{", template[start:])
    at, name = fields.index("{year}"), F.input_file_name()
    if fields[at + 2 : at + 3] == ["{month}"] and fields[at + 1] not in plain and not re.search(r"\d", fields[at + 1]):
        # One search in the name finds both.
        own = {at: r"(\d+", at + 2: r"\d+)"}
        pattern = "/" + "".join(own.get(i) or plain.get(f, re.escape(f)) for i, f in enumerate(fields))
        return F.replace(F.regexp_extract(name, pattern, 1), F.lit(fields[at + 1]), F.lit("-"))
    groups = {"{year}": r"(\d+)", "{month}": r"(\d+)", **plain}
    pattern = "/" + "".join(groups.get(f, re.escape(f)) for f in fields)
    order = [f for f in fields if f in ("{year}", "{month}")]
    return F.concat_ws("-", *[F.regexp_extract(name, pattern, order.index(f) + 1) for f in ("{year}", "{month}")])


def read_log_months(spark: SparkSession, template: str, months: Sequence[str], schema: StructType, month: str = "month") -> tuple[list[str], DataFrame | None]:
    """The months of a log whose folders exist, and all their records (see ``read_records``) with the month of their folder; one scan."""
    found, (paths,) = present_months(spark, months, template)
    if not found:
        return found, None
    return found, read_records(spark, paths, schema).select("*", folder_month(template).alias(month))


def strip_prefix(path: str, prefix: str = "") -> str:
    """Remove a mount prefix from a path, wherever it stands."""
    return path.replace(prefix, "") if prefix else path


def choose_format(path: str, fmt: str = "infer") -> str:
    """The given format, or the first known one whose name occurs in the path."""
    if fmt != "infer":
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}; choose one of {FORMATS} or 'infer'")
        return fmt
    for known in FORMATS:
        if known in path:
            return known
    raise ValueError(f"no format is given and none of {FORMATS} occurs in {path!r}")


def read_any(
    spark: SparkSession,
    path: str,
    fmt: str = "infer",
    schema: StructType | str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Read a source whose format is given or follows from its path.

    Avro needs the external spark-avro package on the cluster. Without a schema,
    JSON is inferred, which costs a pass over the data.
    """
    path = strip_prefix(path, prefix)
    chosen = choose_format(path, fmt)
    reader = spark.read.format(chosen)
    if schema is not None:
        reader = reader.schema(schema)
    if chosen == "csv":
        reader = reader.option("nullValue", "null").option("mode", "FAILFAST")
    return reader.load(path)


def select_positions(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Columns by position, renamed; only these are parsed from a CSV."""
    columns: list[Column] = [
        F.col(df.columns[p]).alias(name) for p, name in zip(positions, names, strict=True)
    ]
    return df.select(*columns)
