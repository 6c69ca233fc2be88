"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), replace: bool = True
) -> None:
    """Write parquet. With partitions, ``replace`` swaps only those that ``df`` has rows for."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def text_lines(df: DataFrame) -> DataFrame:
    """Every row as one line of JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def dump_text(spark: SparkSession, source: str, path: str) -> None:
    """All parquet files of a directory as text."""
    text_lines(spark.read.parquet(source)).write.mode("overwrite").text(path)


def write_sample(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write rows as JSON lines (nested rows as nested objects) or as parquet."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown output format {fmt!r}; choose 'json' or 'parquet'")
    df.write.mode("overwrite").format(fmt).save(path)


def input_stamp(df: DataFrame) -> str:
    """A digest of the paths, sizes and modification times of the files that ``df`` reads."""
    files = df.inputFiles()
    if not files:
        return "no files"
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    row = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{row[0]} files {row[1]}"


def _stamped(spark: SparkSession, path: str) -> str | None:
    try:
        return spark.read.schema("value string").text(f"{path}.inputs").agg(F.max("value")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _stamp(spark: SparkSession, path: str, text: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}.inputs")


def build_once(df: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """Write a derived table, unless one of the same inputs is there, and read it back.

    A stamp beside the table tells which input files it was built from. It is cleared before the
    table is written and set afterwards, so that the remains of a lost job are built anew.
    """
    spark, inputs = df.sparkSession, input_stamp(df)
    if refresh or _stamped(spark, path) != inputs:
        _stamp(spark, path, "being written")
        df.write.mode("overwrite").parquet(path)
        _stamp(spark, path, inputs)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_once(df: DataFrame, table: str, key: str, buckets: int, refresh: bool = False) -> DataFrame:
    """Save a derived lookup as a table bucketed and sorted by its key, unless it exists for the same inputs; read it back.

    A join on the key then shuffles only the other side. That suits sides whose keys are even:
    Spark's adaptive skew join does not split the partitions of a bucketed table. The stamp of the inputs is a
    property of the table, which a table that was not finished does not have.
    """
    spark, inputs = df.sparkSession, input_stamp(df)
    known = None
    if spark.catalog.tableExists(table):
        properties = {r["key"]: r["value"] for r in spark.sql(f"show tblproperties {table}").collect()}
        known = properties.get("tidemark.inputs")
    if refresh or known != inputs:
        (
            df.repartition(buckets, key)
            .write.mode("overwrite")
            .bucketBy(buckets, key)
            .sortBy(key)
            .format("parquet")
            .saveAsTable(table)
        )
        spark.sql(f"alter table {table} set tblproperties ('tidemark.inputs' = '{inputs}')")
    return spark.table(table)
