"""Command line: ``spark-submit run.py <job> ...``.

Paths, dates and months are parameters; nothing is tied to one cluster.
"""

from __future__ import annotations

import argparse
import datetime
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import rolling, sets, summaries
from tidemark.operators.counts import Counts
from tidemark.plans import daily_jobs, rolling_jobs, sampling, transfer_jobs
from tidemark.sources import readers, schemas, sinks


def _source_path(text: str) -> tuple[str, str]:
    name, _, path = text.partition("=")
    if name not in daily_jobs.SOURCES or not path:
        raise argparse.ArgumentTypeError(
            f"expected <source>=<path> with a source of {', '.join(daily_jobs.SOURCES)}"
        )
    return name, path


def _source_keys(text: str) -> tuple[str, list[str]]:
    name, keys = _source_path(text)
    return name, keys.split(",")


def _condition(text: str) -> tuple[str, str]:
    column, _, value = text.partition("=")
    if not column or not value:
        raise argparse.ArgumentTypeError("expected <column>=<value>")
    return column, value


def _day(text: str) -> int:
    """A day number, from itself or from a date."""
    try:
        return int(text) if text.lstrip("-").isdigit() else (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days
    except ValueError:
        raise argparse.ArgumentTypeError(f"expected a day number or yyyy-MM-dd, not {text}") from None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    daily = jobs.add_parser("daily", help="daily working sets of one or more access logs")
    daily.add_argument(
        "--log",
        type=_source_path,
        action="append",
        required=True,
        help="<source>=<path template with {dates}>; may be repeated",
    )
    daily.add_argument("--dates", default="2020/*/*", help="date portion of the log paths")
    daily.add_argument(
        "--months", nargs="+", help="yyyy-MM ...: compute and replace these months only; the log paths have {year} and {month} then"
    )
    daily.add_argument("--datasets", required=True, help="dataset catalogue (CSV)")
    daily.add_argument("--files", required=True, help="file catalogue (CSV)")
    daily.add_argument("--catalogue", help="where to keep the joined file catalogue between runs")
    daily.add_argument("--catalogue-table", help="keep it as a table bucketed by file name instead")
    daily.add_argument("--buckets", type=int, default=1024, help="buckets of that table")
    daily.add_argument("--keys", type=_source_keys, action="append", default=[], help="<source>=<column,column>: grouping")
    daily.add_argument(
        "--arrays", type=int, nargs="?", const=sets.PIECES, default=0, metavar="PIECES", help="arrays in so many pieces of each group, not one row per member"
    )
    daily.add_argument("--bad-share", type=float, default=0.01, help="share of broken records above which --months fails; default 0.01")
    daily.add_argument("--replace", action="store_true", help="replace tables that are there, with all their dates")
    daily.add_argument("--refresh", action="store_true", help="build the kept catalogue anew")
    daily.add_argument("--out", required=True, help="folder that gets a table per source")

    compare = jobs.add_parser("compare", help="rolling footprint of daily tables and their union")
    compare.add_argument(
        "--daily",
        action="append",
        required=True,
        help="<name>=<path> of a table with block arrays; may be repeated",
    )
    compare.add_argument(
        "--daily-datasets",
        action="append",
        default=[],
        help="<name>=<path> of a table with dataset arrays; may be repeated",
    )
    compare.add_argument("--blocks", required=True, help="block catalogue (CSV)")
    compare.add_argument("--tiers", required=True, help="tier names (CSV with header)")
    compare.add_argument("--lookback", type=int, action="append", help="days; default 7")
    compare.add_argument("--now", type=float, help="UNIX time that ends the axis; default: the clock")
    compare.add_argument("--show-from", type=_day, help="day number or date from which rows are written; earlier days still count for the footprint")
    compare.add_argument("--report", help="where to write how many rows have no size, and the blocks that the catalogue lacks")
    compare.add_argument("--out", required=True)

    footprint = jobs.add_parser("footprint", help="carry the comparison on by the days since the last run")
    footprint.add_argument("--daily", action="append", default=[], help="<name>=<path> of a table of blocks; may be repeated")
    footprint.add_argument("--daily-datasets", action="append", default=[], help="<name>=<path> of a table of datasets; may be repeated")
    footprint.add_argument("--blocks", required=True, help="block catalogue (CSV)")
    footprint.add_argument("--tiers", required=True, help="tier names (CSV with header)")
    footprint.add_argument("--lookback", type=int, action="append", help="days; default 7")
    footprint.add_argument("--now", type=float, help="UNIX time two days after the last day; default: the clock")
    footprint.add_argument("--first-day", type=_day, default=rolling.FIRST_DAY, help="day number or date on which the axis begins")
    footprint.add_argument("--back-to", type=_day, help="start from the state of this day (number or date), and replace what came after it")
    footprint.add_argument("--out", required=True, help="folder of state, series and stays")

    cut = jobs.add_parser("slice", help="rolling footprint and mean recall of a part of a daily table")
    cut.add_argument("--daily", required=True, help="path of a daily table")
    cut.add_argument("--datasets", action="store_true", help="its members are datasets, not blocks")
    cut.add_argument("--blocks", required=True, help="block catalogue (CSV)")
    cut.add_argument("--tiers", required=True, help="tier names (CSV with header)")
    cut.add_argument("--tier", default="MINIAOD", help="part of the tier's name")
    cut.add_argument("--equal", type=_condition, action="append", default=[], help="<column>=<text>")
    cut.add_argument("--starts", type=_condition, action="append", default=[], help="<column>=<pattern for its start>")
    cut.add_argument("--flag", help="column that must be true")
    cut.add_argument("--lookback", type=int, action="append", help="days; default 7, 30, 90 and 120")
    cut.add_argument("--show-from", type=_day, help="day number or date from which rows are shown")
    cut.add_argument("--out", required=True, help="folder that gets series and mean_recall")

    sizes = jobs.add_parser("histograms", help="records and distinct items per group of a log, and their histograms")
    sizes.add_argument("--log", type=_source_path, required=True, help="<source>=<path template with {dates}>")
    sizes.add_argument("--dates", default="2020/*/*", help="date portion of the log paths")
    sizes.add_argument("--datasets", required=True, help="dataset catalogue (CSV)")
    sizes.add_argument("--files", required=True, help="file catalogue (CSV)")
    sizes.add_argument("--keys", help="<column,column>: grouping columns of the log beside day, campaign and tier")
    sizes.add_argument("--out", required=True, help="folder that gets groups and histograms")

    transfers = jobs.add_parser("transfers", help="monthly transfer locality")
    transfers.add_argument("--log", required=True, help="path template with {year} and {month}")
    transfers.add_argument("--replicas", required=True, help="path template with {year} and {month}")
    transfers.add_argument("--files", required=True)
    transfers.add_argument("--datasets", required=True)
    transfers.add_argument("--blocks", required=True)
    transfers.add_argument(
        "--hot-share", type=float, default=0.001, help="spread files with about this share of the reads of earlier runs; default 0.001"
    )
    transfers.add_argument("--first-of-month", action="store_true", help="only snapshots dated the first of a month")
    transfers.add_argument("--carry-days", type=int, default=0, help="days for which a snapshot stands")
    transfers.add_argument("--row-id", help="column of the log that tells records apart, if each is to count")
    transfers.add_argument("--allow-none", action="store_true", help="no month with input is no error")
    transfers.add_argument("--months", nargs="+", required=True, help="yyyy-MM ...")
    transfers.add_argument("--out", required=True)

    overview = jobs.add_parser("overview", help="reports over the monthly transfer table")
    overview.add_argument("--matrix", required=True)
    overview.add_argument("--months", nargs="+")
    overview.add_argument("--out", required=True)

    sample = jobs.add_parser("sample", help="random sample of a source")
    sample.add_argument("source")
    sample.add_argument("out")
    sample.add_argument(
        "-i", "--input-format", default="infer", choices=[*readers.FORMATS, "infer"]
    )
    sample.add_argument("-o", "--output-format", default="json", choices=["json", "parquet"])
    sample.add_argument("-n", "--samples", type=int, default=100, help="approximate number of rows")
    sample.add_argument("--strip-prefix", default="", help="mount prefix to remove from the path")
    sample.add_argument("--seed", type=int)

    dump = jobs.add_parser("dump", help="a parquet folder as text lines")
    dump.add_argument("source")
    dump.add_argument("out")
    return top


def run_compare(spark: SparkSession, args: argparse.Namespace) -> None:
    blocks = readers.read_catalogue(spark, args.blocks, schemas.BLOCKS)
    axis = rolling.fixed_axis(time.time() if args.now is None else args.now)
    tables = {}
    for text in args.daily:
        name, _, path = text.partition("=")
        tables[name] = _daily_table(spark, path, None, axis)
    for text in args.daily_datasets:
        name, _, path = text.partition("=")
        tables[name] = _daily_table(spark, path, blocks, axis)
    counts = Counts() if args.report else None
    series = rolling_jobs.aod_comparison(
        tables,
        readers.read_catalogue(spark, args.tiers, schemas.TIER_NAMES, header=True),
        blocks,
        axis=axis,
        lookbacks=args.lookback or [7],
        counts=counts,
    )
    sinks.write_table(series if args.show_from is None else summaries.from_day(series, args.show_from), args.out)
    if args.report:
        found = counts.values()
        report = spark.createDataFrame([(found["rows_with_items"], found["rows_without_size"])], "rows_with_items bigint, rows_without_size bigint")
        sinks.write_table(report.coalesce(1), f"{args.report}/counts")
        sinks.write_table(rolling_jobs.missing_blocks(tables, blocks), f"{args.report}/missing_blocks")


def run_footprint(spark: SparkSession, args: argparse.Namespace) -> None:
    blocks = readers.read_catalogue(spark, args.blocks, schemas.BLOCKS)
    paths = [(*t.split("=", 1), None) for t in args.daily] + [(*t.split("=", 1), blocks) for t in args.daily_datasets]
    first, through = rolling.fixed_axis(time.time() if args.now is None else args.now, args.first_day)
    rolling_jobs.run_footprint(
        spark,
        lambda days: {name: _daily_table(spark, path, parts, days) for name, path, parts in paths},
        readers.read_catalogue(spark, args.tiers, schemas.TIER_NAMES, header=True),
        blocks,
        args.out,
        through,
        first,
        args.lookback or [7],
        back_to=args.back_to,
    )


def run_slice(spark: SparkSession, args: argparse.Namespace) -> None:
    blocks = readers.read_catalogue(spark, args.blocks, schemas.BLOCKS)
    series = rolling_jobs.daily_slice(
        _daily_table(spark, args.daily, blocks if args.datasets else None),
        readers.read_catalogue(spark, args.tiers, schemas.TIER_NAMES, header=True),
        blocks,
        args.tier,
        dict(args.equal),
        dict(args.starts),
        args.flag,
        lookbacks=args.lookback or rolling.LOOKBACKS,
    )
    sinks.write_table(series, f"{args.out}/series")
    series = spark.read.parquet(f"{args.out}/series")
    sinks.write_table(rolling_jobs.mean_recall(series), f"{args.out}/mean_recall")
    if args.show_from is not None:
        sinks.write_table(summaries.from_day(series, args.show_from), f"{args.out}/shown")


def _daily_table(
    spark: SparkSession, path: str, blocks: DataFrame | None, days: tuple[int, int] | None = None
) -> rolling_jobs.DailyTable:
    """A daily table in either form, of all days or those in a range; with ``blocks``, one of datasets."""
    df = daily_jobs.read_daily_table(spark, path, days)
    arrays, member = ("working_set_blocks", "f_block_id") if blocks is None else ("working_set", "d_dataset_id")
    parts = None if blocks is None else daily_jobs.dataset_blocks(blocks)
    return rolling_jobs.DailyTable(df, arrays if arrays in df.columns else member, parts)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = (
        SparkSession.builder.appName(f"tidemark {args.job}")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    if args.job == "daily" and args.months:
        found = daily_jobs.run_daily_months(
            spark, dict(args.log), args.months, args.datasets, args.files, args.out, args.catalogue, args.catalogue_table, args.buckets,
            dict(args.keys), args.refresh, args.bad_share,
        )
        for source, months in found.items():
            for month in [m for m in args.months if m not in months]:
                print(f"skipped {month} of {source}: no log folder", file=sys.stderr)
    elif args.job == "footprint":
        run_footprint(spark, args)
    elif args.job == "daily":
        daily_jobs.run_daily(
            spark,
            dict(args.log),
            args.datasets,
            args.files,
            args.out,
            args.dates,
            args.catalogue,
            args.catalogue_table,
            args.buckets,
            dict(args.keys),
            args.arrays,
            args.replace,
            args.refresh,
        )
    elif args.job == "compare":
        run_compare(spark, args)
    elif args.job == "slice":
        run_slice(spark, args)
    elif args.job == "histograms":
        daily_jobs.run_group_sizes(
            spark, *args.log, args.datasets, args.files, args.out, args.dates, args.keys.split(",") if args.keys else None
        )
    elif args.job == "transfers":
        found = transfer_jobs.run_transfers(
            spark,
            args.log,
            args.replicas,
            args.files,
            args.datasets,
            args.blocks,
            args.out,
            args.months,
            args.hot_share,
            args.first_of_month,
            args.carry_days,
            args.row_id,
        )
        for month in [m for m in args.months if m not in found]:
            print(f"skipped {month}: a log or a snapshot folder is missing", file=sys.stderr)
        if not found and not args.allow_none:
            raise SystemExit("no month has input")
    elif args.job == "overview":
        matrix = transfer_jobs.load_transfers(spark, args.matrix, args.months)
        sinks.write_table(transfer_jobs.overview(matrix), f"{args.out}/overview")
        for client, server in (("us", "eu"), ("eu", "us")):
            sinks.write_table(
                transfer_jobs.cross_region(matrix, client, server), f"{args.out}/{client}_{server}"
            )
    elif args.job == "sample":
        sampling.run_sample(
            spark,
            args.source,
            args.out,
            args.samples,
            args.input_format,
            args.output_format,
            args.strip_prefix,
            args.seed,
        )
    else:
        sinks.dump_text(spark, args.source, args.out)


if __name__ == "__main__":
    main()
