"""Distinct items touched per day.

Logs are reduced to distinct (day, keys, name) rows *before* they meet the
catalogue. The results are sets, so this changes nothing, and it caps how often a
popular file can occur in the join: once per day and key combination, however
many times it was opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import CAMPAIGN_PATTERN, campaign
from tidemark.functions.timeline import day_start
from tidemark.operators import bitmaps
from tidemark.operators.counts import Counts


def datasets_with_campaign(datasets: DataFrame, pattern: str = CAMPAIGN_PATTERN) -> DataFrame:
    """The dataset columns that the daily sets need, with the campaign."""
    return datasets.select(
        "d_dataset_id",
        "d_dataset",
        "d_data_tier_id",
        campaign("d_dataset", pattern).alias("input_campaign"),
    )


def file_catalogue(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """File name -> block, dataset, tier and campaign, in one table.

    Joining the two catalogue tables first leaves a single join for the log.
    """
    return files.select("f_logical_file_name", "f_block_id", "f_dataset_id").join(
        datasets_with_campaign(datasets).drop("d_dataset"),
        F.col("f_dataset_id") == F.col("d_dataset_id"),
    )


def touched_per_day(
    log: DataFrame, name: str, keys: Sequence[str], time: str = "timestamp"
) -> DataFrame:
    """Distinct (day, keys, name) of a log; day in seconds."""
    return log.select(day_start(time).alias("day"), *keys, name).distinct()


def _known(touched: DataFrame, catalogue: DataFrame, name: str, known: str, counts: Counts | None, hashed: bool = False) -> DataFrame:
    """The rows whose name the catalogue knows, with its columns; ``hashed`` as in ``daily_blocks``."""
    same = F.col(name) == F.col(known)
    if hashed:
        # Computed on both sides of the shuffle, as it would make the rows longer.
        same = (F.xxhash64(name) == F.xxhash64(known)) & same
    if counts is None:
        return touched.join(catalogue, same)
    missing = F.col(known).isNull()
    joined = counts.watch(touched.join(catalogue, same, "left"), distinct_names=None, names_without_entry=missing)
    return joined.where(~missing)


def daily_datasets(
    log: DataFrame,
    datasets: DataFrame,
    keys: Sequence[str] = (),
    name: str = "dataset_name",
    time: str = "timestamp",
    group_cols: Sequence[str] = ("input_campaign", "d_data_tier_id"),
    counts: Counts | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Distinct dataset ids per day and group, for logs that name datasets; ``counts`` and ``hashed`` as in ``daily_blocks``."""
    touched = touched_per_day(log, name, keys, time)
    return (
        _known(touched, datasets_with_campaign(datasets), name, "d_dataset", counts, hashed)
        .select("day", *group_cols, *keys, "d_dataset_id")
        .distinct()
    )


def daily_blocks(
    log: DataFrame,
    catalogue: DataFrame,
    keys: Sequence[str] = (),
    name: str = "file_lfn",
    time: str = "timestamp",
    group_cols: Sequence[str] = ("input_campaign", "d_data_tier_id"),
    item: str = "f_block_id",
    counts: Counts | None = None,
    reduced: bool = False,
    hashed: bool = False,
) -> DataFrame:
    """Distinct block ids (or another catalogue id) per day and group, for logs that name files.

    ``catalogue`` is what ``file_catalogue`` gives. ``counts`` learns how many distinct (day, keys, name) rows there are, and how
    many of them the catalogue does not know; the join then keeps those up to the count. With ``reduced``, the catalogue loses the
    files that no record names (see ``bitmaps.possible_names``) before it is shuffled, at the price of another look at the names in the
    log: for a few days of log and a large catalogue that is not kept in buckets. With ``hashed``, the join sorts by a hash of the name
    and then by the name: names begin alike, and sorts of them compare whole texts. Not for a catalogue kept in buckets by name.
    """
    touched = touched_per_day(log, name, keys, time)
    if reduced:
        catalogue = bitmaps.possible_names(catalogue, "f_logical_file_name", bitmaps.name_filter(log, name))
    return (
        _known(touched, catalogue, name, "f_logical_file_name", counts, hashed)
        .select("day", *group_cols, *keys, item)
        .distinct()
    )


def items_by_keys(
    accesses: DataFrame, keys: Mapping[str, Column | str], item: Column | str, out: str = "item"
) -> DataFrame:
    """Distinct items per key combination of any table; keys are given as name -> column."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return accesses.select(
        *[as_col(c).alias(n) for n, c in keys.items()], as_col(item).alias(out)
    ).distinct()


def group_sizes(
    accesses: DataFrame,
    keys: Sequence[str],
    item: str,
    n_items: str = "nblocks",
    n_records: str = "njobs",
) -> DataFrame:
    """Distinct items and records per group.

    Two aggregation steps with partial sums on both, so a hot group is spread
    over its items and never gathered as a set.
    """
    return (
        accesses.groupBy(*keys, item)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.count(item).alias(n_items), F.sum("_n").alias(n_records))
    )


def records_per_day(accesses: DataFrame, day: str = "day", out: str = "n_records") -> DataFrame:
    return accesses.groupBy(day).agg(F.count(F.lit(1)).alias(out))


def days_with_data(df: DataFrame, day: str = "day", by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, day).distinct()
