"""Monthly transfer locality and the reports over it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import necessity_label, route_label
from tidemark.operators import skew, transfers
from tidemark.sources import published, readers, schemas


_SKETCH = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"


def monthly_transfers(
    log: DataFrame,
    files: DataFrame,
    datasets: DataFrame,
    blocks: DataFrame,
    replicas: DataFrame,
    first_of_month: bool = True,
    carry_days: int = 0,
    row_id: str | None = None,
    labels: Mapping[str, str] | None = None,
    hot_files: DataFrame | None = None,
    month: str | None = None,
    observed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Bytes read by month, server region, client region and local availability.

    All months come from one job. By default a month is represented by the reads on
    the date of its first snapshot; ``carry_days`` lets a snapshot stand for later
    dates too, and ``first_of_month=False`` admits all snapshots. ``log`` is the flattened
    log; ``row_id`` names a column that tells its records apart, if each is to count. ``hot_files``
    (one column of names) changes how the work is spread, not the result. ``month`` names a column of
    ``log`` and ``replicas`` with the month that a row belongs to: reads then meet snapshots of their own month
    only and count for it, whatever their date says. ``observed`` may watch the reads that go into the join.
    """
    carry = [month] if month else []
    reads = transfers.read_accesses(log, labels, row_id, carry)
    if observed is not None:
        reads = observed(reads)
    of_blocks = transfers.reads_of_blocks(
        reads, transfers.file_blocks(files, datasets), row_id, hot_files, carry
    )
    block_bytes = transfers.bytes_per_block(of_blocks, blocks, labels, carry)
    dated = transfers.dated_replicas(replicas, first_of_month, carry)
    calendar = transfers.snapshot_calendar(dated, carry_days, carry) if carry_days else None
    regions = transfers.replica_regions(dated, labels, carry)
    return transfers.transfer_matrix(transfers.locality(block_bytes, regions, calendar, carry), month)


def run_transfers(
    spark: SparkSession,
    log_template: str,
    replica_template: str,
    files_path: str,
    datasets_path: str,
    blocks_path: str,
    out: str,
    months: Sequence[str],
    hot_share: float | None = 0.001,
    first_of_month: bool = False,
    carry_days: int = 0,
    row_id: str | None = None,
) -> list[str]:
    """Compute the months whose input exists and replace their partitions; returns those months.

    A month is that of the folders, in every step: a record or snapshot dated the day before belongs to the
    month whose folder holds it. The months found are replaced all at once when all are done (see
    ``sources.published``), and one without any rows ends up empty; a run that fails leaves the table as it was.
    Files with at least ``hot_share`` of the reads are spread in the join with the catalogue. Which they are is known from sketches (see
    ``skew.sketch``) that earlier runs took on their way and left in ``<out>/sketches``; each run adds that of its own reads, and
    none reads the log twice. The first run, and None, leave hot files to adaptive execution. The result is the same.
    """
    found, (logs, snapshots) = readers.present_months(
        spark, months, log_template, replica_template
    )
    if not found:
        return found

    log = spark.read.schema(schemas.TRANSFER_REPORTS).json(logs)
    log = log.select("data.*", readers.folder_month(log_template).alias("_month"))
    replicas = readers.read_catalogue(spark, snapshots, schemas.REPLICAS)
    replicas = replicas.select("*", readers.folder_month(replica_template).alias("_month"))
    hot = None
    sketches = published.manifest(spark, f"{out}/sketches")
    if hot_share is not None and any(p.run for p in sketches.periods.values()):
        hot = skew.sketched_keys(published.read_published(spark, f"{out}/sketches", known=sketches), "file_lfn", hot_share)
    seen = Observation()
    matrix = monthly_transfers(
        log,
        readers.read_catalogue(spark, files_path, schemas.FILES),
        readers.read_catalogue(spark, datasets_path, schemas.DATASETS),
        readers.read_catalogue(spark, blocks_path, schemas.BLOCKS),
        replicas,
        first_of_month=first_of_month,
        carry_days=carry_days,
        row_id=row_id,
        hot_files=hot,
        month="_month",
        observed=lambda reads: reads.observe(seen, skew.sketch("file_lfn").alias("sketch"), F.count(F.lit(1)).alias("n_rows")),
    )
    # A few rows per month: one per pair of regions and availability.
    published.publish(matrix.coalesce(1), out, "year_month", found)
    taken = seen.get
    if taken["n_rows"]:
        one = spark.createDataFrame([(max(found), taken["n_rows"], taken["sketch"])], f"month string, n_rows bigint, sketch {_SKETCH}")
        published.publish(one, f"{out}/sketches", "month", [max(found)])
    return found


def load_transfers(
    spark: SparkSession, path: str, months: Sequence[str] | None = None
) -> DataFrame:
    """The published matrix, or a plain folder of months."""
    known = published.manifest(spark, path)
    if known.schema is not None:
        return published.read_published(spark, path, "year_month", months, known=known)
    return readers.read_months(spark, path, schemas.TRANSFER_MATRIX, months)


def overview(matrix: DataFrame) -> DataFrame:
    """Bytes by month and region pair, with a text label for the pair."""
    return transfers.monthly_overview(matrix).withColumn(
        "route", route_label("client_location", "server_location")
    )


def cross_region(matrix: DataFrame, client: str, server: str) -> DataFrame:
    """Monthly bytes that clients of one region read from servers of another, labelled by need."""
    return matrix.where(
        (F.col("client_location") == client) & (F.col("server_location") == server)
    ).withColumn(
        "necessity",
        necessity_label("dataset_at_client_location", F.lit(client), F.lit(server)),
    )
