"""Samples of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks


#: Ranges in which an exact sample counts its rows.
RANGES = 1 << 16


def sample_rows(df: DataFrame, n: int = 100, seed: int | None = None) -> DataFrame:
    """Each row with equal chance, about ``n`` in all; an empty source gives an empty sample.

    The number of rows is counted by the query itself.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    chance = F.rand() if seed is None else F.rand(seed)
    return df.where(chance * total < n)


def sample_exactly(df: DataFrame, n: int = 100, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer.

    Every row draws a number. The rows of each of ``RANGES`` equal ranges of numbers are counted; whole ranges are taken as long as
    they fit, and of the one on the border, a 65,536th of the rows, those with the least numbers. So the sample is never sorted,
    nor gathered in one task. The source must give its rows in the same order both times, as files do.
    """
    chance = (F.rand() if seed is None else F.rand(seed)).alias("_chance")
    drawn = df.select("*", chance).withColumn("_range", F.floor(F.col("_chance") * RANGES).cast("int"))
    # At most RANGES rows.
    counts = sorted((r["_range"], r["count"]) for r in drawn.groupBy("_range").count().collect())
    border, before = RANGES, 0
    for border, count in counts:
        if before + count > n:
            break
        before += count
    else:
        border = RANGES
    order = Window.partitionBy("_range").orderBy("_chance")
    some = drawn.where(F.col("_range") == border).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n - before)
    return drawn.where(F.col("_range") < border).unionByName(some.drop("_place")).drop("_chance", "_range")


def run_sample(
    spark: SparkSession,
    source: str,
    out: str,
    n: int = 100,
    fmt: str = "infer",
    out_format: str = "json",
    prefix: str = "",
    seed: int | None = None,
) -> None:
    """Sample a source of known or inferred format into files."""
    df = readers.read_any(spark, source, fmt, prefix=prefix)
    sinks.write_sample(sample_rows(df, n, seed), out, out_format)
