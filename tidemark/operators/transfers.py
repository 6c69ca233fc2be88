"""Transfer locality: bytes read across regions, and whether a nearer replica existed.

Dates are UTC. Three things keep the joins narrow and even. The log meets the catalogue in one
join, for the block id; block names come in after the summing. Replicas shrink to one small set of regions per
(date, block) before they meet the reads, so no read is multiplied by its
replicas. And the bytes are summed per (date, block, region pair) first, so a block
that draws a third of all reads brings only a handful of rows to that join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.regions import host_region, node_region, region_labels
from tidemark.functions.timeline import day_date, day_number, millis_to_seconds, month_text
from tidemark.operators.skew import spread_join

# The grouping of one read, which has second resolution and no file name.
READ_KEY = (
    "read_second",
    "client_domain",
    "client_host",
    "server_domain",
    "f_block_id",
    "read_bytes",
    "write_bytes",
)


def file_blocks(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """File name -> block id, for files whose dataset is known."""
    return (
        files.select("f_logical_file_name", "f_dataset_id", "f_block_id")
        .join(
            datasets.select(F.col("d_dataset_id").alias("f_dataset_id")),
            "f_dataset_id",
            "left_semi",
        )
        .drop("f_dataset_id")
    )


def read_accesses(
    log: DataFrame, labels: Mapping[str, str] | None = None, row_id: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Read operations by clients whose region is known, from the flattened log.

    Both filters need the log only and so run in its scan. The date follows from the
    time and the operation is constant, so neither is carried along.
    """
    extra = [*carry, *([row_id] if row_id else [])]
    return log.where(
        (F.col("operation") == "read") & host_region("client_domain", labels).isNotNull()
    ).select(
        "file_lfn",
        millis_to_seconds("start_time").cast("bigint").alias("read_second"),
        "client_domain",
        "client_host",
        "server_domain",
        "read_bytes",
        "write_bytes",
        *extra,
    )


def reads_of_blocks(
    reads: DataFrame,
    catalogue: DataFrame,
    row_id: str | None = None,
    hot_files: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Reads with their block id, each counted once; ``catalogue`` is from ``file_blocks``.

    Here a popular file meets its rows in full. Adaptive execution splits such a partition, at the
    price of reading the catalogue's part of it once per split; with ``hot_files``, the names of
    popular files, their rows are spread instead.

    By default, reads that agree in block, second, client, server and bytes
    are taken as one. With ``row_id``, every log record counts.
    """
    key = [*READ_KEY, *carry, *([row_id] if row_id else [])]
    if hot_files is None:
        joined = reads.join(catalogue, F.col("file_lfn") == F.col("f_logical_file_name"))
    else:
        joined = spread_join(reads, catalogue, "file_lfn", "f_logical_file_name", hot_files)
    return joined.select(*key).distinct()


def dated_replicas(replicas: DataFrame, first_of_month: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Replicas with their snapshot date; ``first_of_month`` keeps only the first day of each month."""
    dated = replicas.select(
        day_date(day_number(F.col("now_sec").cast("bigint"))).alias("snapshot_date"),
        "block_name",
        "node_name",
        *carry,
    )
    return dated.where(F.day("snapshot_date") == 1) if first_of_month else dated


def replica_regions(dated: DataFrame, labels: Mapping[str, str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Regions that hold a block on a snapshot date: ``(snapshot_date, block_name, regions)``.

    There are only as many regions as the label table names, so the set is gathered as one
    flag each, which Spark aggregates in generated code, and becomes an array at the end.
    """
    table = region_labels() if labels is None else labels
    names = sorted(set(table.values()))
    located = dated.select(
        *carry, "snapshot_date", "block_name", node_region("node_name", table).alias("_region")
    )
    flags = located.groupBy(*carry, "snapshot_date", "block_name").agg(
        *[
            F.bool_or(F.col("_region") == name).alias(f"_in_{i}") for i, name in enumerate(names)
        ]
    )
    none = F.array().cast("array<string>")
    held = [F.when(F.col(f"_in_{i}"), F.array(F.lit(n))).otherwise(none) for i, n in enumerate(names)]
    return flags.select(*carry, "snapshot_date", "block_name", F.concat(*held).alias("regions"))


def snapshot_calendar(dated: DataFrame, carry_days: int, carry: Sequence[str] = ()) -> DataFrame:
    """``(read_date, snapshot_date)``: the latest snapshot at or up to ``carry_days`` before a date.

    A snapshot replaces the one before as a whole, so a block missing from it has no
    replica from then on. The table has one row per calendar day at most.
    """
    ordered = Window.partitionBy(*carry).orderBy("snapshot_date")  # one row per snapshot date
    return (
        dated.select(*carry, "snapshot_date")
        .distinct()
        .select(
            *carry,
            "snapshot_date",
            F.least(
                F.date_add("snapshot_date", carry_days),
                F.date_sub(F.lead("snapshot_date").over(ordered), 1),
            ).alias("_until"),
        )
        .select(
            *carry, F.explode(F.sequence("snapshot_date", "_until")).alias("read_date"), "snapshot_date"
        )
    )


def bytes_per_block(
    reads: DataFrame, blocks: DataFrame, labels: Mapping[str, str] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Bytes read per date, block name and region pair, for known blocks."""
    summed = reads.groupBy(
        *carry,
        day_date(day_number("read_second")).alias("read_date"),
        "f_block_id",
        host_region("server_domain", labels).alias("server_location"),
        host_region("client_domain", labels).alias("client_location"),
    ).agg(F.sum("read_bytes").alias("_bytes"))
    names = blocks.select("b_block_id", F.col("b_block_name").alias("block_name"))
    return summed.join(names, F.col("f_block_id") == F.col("b_block_id")).drop(
        "f_block_id", "b_block_id"
    )


def locality(
    block_bytes: DataFrame, regions: DataFrame, calendar: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Add whether the client's own region holds the block; drop blocks without a snapshot.

    A read is judged by the snapshot of its own date, or by that which ``calendar`` (see
    ``snapshot_calendar``) names for it.
    """
    if calendar is None:
        dated = block_bytes.withColumn("snapshot_date", F.col("read_date"))
    else:
        # One row per calendar day: the size is bounded by the span of the snapshots.
        dated = block_bytes.join(F.broadcast(calendar), [*carry, "read_date"])
    return (
        dated.join(regions, [*carry, "snapshot_date", "block_name"])
        .withColumn(
            "dataset_at_client_location", F.array_contains("regions", F.col("client_location"))
        )
        .drop("regions", "snapshot_date")
    )


def transfer_matrix(local: DataFrame, month: str | None = None) -> DataFrame:
    """Bytes by month, region pair and availability; an unknown server region stays, as NULL.

    The month is that of the read's date, or the column ``month``.
    """
    keys = ["server_location", "client_location", "dataset_at_client_location"]
    if month is not None:
        return local.groupBy(F.col(month).alias("year_month"), *keys).agg(F.sum("_bytes").alias("total_read_bytes"))
    return (
        local.groupBy(F.trunc("read_date", "month").alias("_month"), *keys)
        .agg(F.sum("_bytes").alias("total_read_bytes"))
        .select(month_text("_month").alias("year_month"), *keys, "total_read_bytes")
    )


def monthly_overview(matrix: DataFrame) -> DataFrame:
    """Bytes by month and region pair; rows without a region on either side are dropped."""
    return (
        matrix.where(F.col("server_location").isNotNull() & F.col("client_location").isNotNull())
        .groupBy("year_month", "server_location", "client_location")
        .agg(F.coalesce(F.sum("total_read_bytes"), F.lit(0)).alias("total_read_bytes"))
    )
