"""Lookups by id: tier names, item sizes, and what the catalogue does not know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.counts import Counts


def with_tier(
    df: DataFrame,
    tiers: DataFrame,
    key: str = "d_data_tier_id",
    tier_id: str = "id",
    tier: str = "data_tier",
    unknown: str = "error",
) -> DataFrame:
    """Add the tier name. ``unknown`` ids raise an ``error``, ``keep`` a NULL or ``drop`` out.

    The check is a filter in the join's own stage: it needs no second pass, and no projection drops it.
    """
    names = tiers.select(F.col(tier_id).alias("_tier_id"), F.col(tier).alias("_tier"))
    if unknown == "drop":
        joined = df.join(names, F.col(key) == F.col("_tier_id"), "inner")
        name = F.col("_tier")
    elif unknown == "keep":
        joined = df.join(names, F.col(key) == F.col("_tier_id"), "left")
        name = F.col("_tier")
    elif unknown == "error":
        joined = df.join(names, F.col(key) == F.col("_tier_id"), "left")
        text = F.concat(
            F.lit("unknown data tier id: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
        )
        joined = joined.where(F.when(F.col("_tier_id").isNull(), F.raise_error(text).cast("boolean")).otherwise(True))
        name = F.col("_tier")
    else:
        raise ValueError(f"unknown must be 'error', 'keep' or 'drop', not {unknown!r}")
    return joined.select(*df.columns, name.alias(tier))


def size_table(sizes: DataFrame, item: str, size: str) -> DataFrame:
    """One bigint size per item as ``(_size_item, _size)``.

    The grouping guards the sums against an id listed twice; it is partitioned
    like the join that follows, so it costs no further shuffle.
    """
    return (
        sizes.where(F.col(item).isNotNull())
        .groupBy(F.col(item).alias("_size_item"))
        .agg(F.max(F.col(size).cast("bigint")).alias("_size"))
    )


def with_size(
    df: DataFrame, item: str, sizes: DataFrame, size_item: str, size: str, out: str = "item_size", counts: Counts | None = None
) -> DataFrame:
    """Add the size of each row's item; an item without a known size counts 0, and is counted in ``counts``.

    The sizes, one narrow row per item, are hashed: a sort-merge join would sort all the accesses once more.
    """
    table = size_table(sizes, size_item, size).hint("shuffle_hash")
    joined = df.join(table, F.col(item) == F.col("_size_item"), "left")
    if counts is not None:
        joined = counts.watch(joined, rows_with_items=None, rows_without_size=F.col("_size_item").isNull())
    return joined.select(
        *df.columns, F.coalesce("_size", F.lit(0)).cast("bigint").alias(out)
    )


def missing_items(df: DataFrame, item: str, sizes: DataFrame, size_item: str) -> DataFrame:
    """Distinct accessed items that the size table does not list."""
    known = sizes.select(F.col(size_item).alias(item))
    return df.where(F.col(item).isNotNull()).select(item).distinct().join(known, item, "left_anti")


def restrict_to_days(
    series: DataFrame,
    valid_days: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = (),
    day: str = "day",
    first_day=None,
    always=None,
) -> DataFrame:
    """Blank the measures on days on which the source has no data.

    ``valid_days`` holds the days (per ``by``) with data. With ``first_day`` (a
    number or column) that day is blanked too. Rows for which the column ``always``
    is true are left as they are.
    """
    on = [*by, day]
    days = valid_days.select(*on).where(F.col(day).isNotNull()).distinct().withColumn("_valid", F.lit(True))
    keep = F.col("_valid")
    if first_day is not None:
        keep = keep & (F.col(day) > first_day)
    if always is not None:
        keep = keep | F.coalesce(always, F.lit(False))
    return series.join(days, on, "left").select(
        *[
            F.when(F.coalesce(keep, F.lit(False)), F.col(c)).alias(c) if c in measures else F.col(c)
            for c in series.columns
        ]
    )
