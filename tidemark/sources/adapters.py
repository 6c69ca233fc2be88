"""The access logs as narrow tables: what was touched, when and from where.

Each adapter takes the flattened log, so that any reader can feed it; columns named in ``carry`` come along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import contains_flag, drop_bracketed
from tidemark.functions.timeline import millis_to_seconds

# What marks the records that count.
DONE_STATUS = "Completed"
SUCCESS_STATE = "success"
FILE_PREFIX = "/store/"
TEMPORARY_PREFIX = "/store/unmerged"
COLLABORATION = "cms"


def batch_jobs(log: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Completed batch jobs with an input dataset.

    ``(dataset_name, site_name, CMS_SubmissionTool, timestamp)``, seconds as double.
    """
    return log.where(
        F.col("DESIRED_CMSDataset").isNotNull() & (F.col("Status") == DONE_STATUS)
    ).select(
        F.col("DESIRED_CMSDataset").alias("dataset_name"),
        F.col("Site").alias("site_name"),
        "CMS_SubmissionTool",
        millis_to_seconds("RecordTime").alias("timestamp"),
        *carry,
    )


def file_opens(log: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Opened files: ``(file_lfn, timestamp, site_name, is_crab)``, seconds as bigint."""
    return log.where(F.col("file_lfn").startswith(FILE_PREFIX)).select(
        "file_lfn",
        F.col("end_time").alias("timestamp"),
        "site_name",
        contains_flag("app_info").alias("is_crab"),
        *carry,
    )


def remote_accesses(log: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Remote accesses: ``(file_lfn, client_domain, timestamp)``, seconds as double."""
    return log.where(
        (F.col("vo") == COLLABORATION) & F.col("file_lfn").startswith(FILE_PREFIX)
    ).select(
        "file_lfn",
        drop_bracketed("client_domain").alias("client_domain"),
        millis_to_seconds("end_time").alias("timestamp"),
        *carry,
    )


def job_inputs(log: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Input files of successful jobs: ``(site_name, file_lfn, timestamp)``.

    The site is that of the first step, NULL for a job without steps.
    """
    lfn = F.col("file_lfn")
    return (
        log.where(F.col("meta_data.jobstate") == SUCCESS_STATE)
        .select(
            F.get("steps.site", F.lit(0)).alias("site_name"),
            F.explode("LFNArray").alias("file_lfn"),
            F.col("meta_data.ts").alias("timestamp"),
            *carry,
        )
        .where(lfn.startswith(FILE_PREFIX) & ~lfn.startswith(TEMPORARY_PREFIX))
    )
