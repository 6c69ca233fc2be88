"""Daily tables by month, and the footprint carried on over them, through the command line."""

from __future__ import annotations

import json

import pytest
from test_cli import csv

from tidemark import cli
from tidemark.plans import daily_jobs, rolling_jobs
from tidemark.sources import readers, schemas

DAY, FEB1 = 86400, 17928  # 2019-02-01 as a day number


def put(tmp_path, month, opens):
    path = tmp_path / "opens" / "2019" / month / "a.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(
        "".join(json.dumps({"data": {"file_lfn": f"/store/{i}", "end_time": d * DAY + 5, "site_name": "S"}}) + "\n" for i, d in opens)
    )


@pytest.fixture
def catalogues(tmp_path):
    files = csv(
        tmp_path / "files", schemas.FILES, *[{"f_logical_file_name": f"/store/{i}", "f_dataset_id": 1, "f_block_id": 10 + i} for i in (1, 2, 3)]
    )
    datasets = csv(tmp_path / "datasets", schemas.DATASETS, {"d_dataset_id": 1, "d_dataset": "/A/B-v1/AOD", "d_data_tier_id": 5})
    blocks = csv(
        tmp_path / "blocks", schemas.BLOCKS, *[{"b_block_id": 10 + i, "b_dataset_id": 1, "b_block_size": 100 * i} for i in (1, 2, 3)]
    )
    tiers = tmp_path / "tiers.csv"
    tiers.write_text("id,data_tier\n5,AOD\n")
    return files, datasets, blocks, str(tiers)


def test_months_are_rerun_and_the_footprint_carried_on(spark, tmp_path, catalogues, capsys):
    files, datasets, blocks, tiers = catalogues
    table = f"{tmp_path}/daily/working_set_cmssw"

    def daily(*months):
        cli.main([
            "daily", "--log", f"cmssw={tmp_path}/opens/{{year}}/{{month}}/*.json", "--months", *months,
            "--datasets", datasets, "--files", files, "--out", f"{tmp_path}/daily",
        ])

    def footprint(last, *more):
        cli.main([
            "footprint", "--daily", f"opens={table}", "--blocks", blocks, "--tiers", tiers, "--lookback", "2", "--first-day", str(FEB1 - 5),
            "--now", str((last + 2) * DAY), "--out", f"{tmp_path}/footprint", *more,
        ])

    def rows():
        series = rolling_jobs.read_footprint(spark, f"{tmp_path}/footprint").where("source = 'union'").collect()
        assert len({r.day for r in series}) == len(series)
        return {r.day - FEB1: (r.n_items, r.ws_size, r.n_recalls) for r in series if r.n_items}

    put(tmp_path, "01", [(1, FEB1 - 2), (2, FEB1 - 1)])
    put(tmp_path, "02", [(2, FEB1 - 1), (2, FEB1), (2, FEB1), (3, FEB1 + 4), (9, FEB1 + 4)])  # begins with a record of the day before
    daily("2019-01", "2019-02", "2019-07")
    assert "skipped 2019-07 of cmssw" in capsys.readouterr().err
    (report,) = spark.read.parquet(f"{tmp_path}/daily/counts").collect()
    # File 9 is in no catalogue; the record of the day before lies in both folders.
    assert report.asDict() == {"source": "cmssw", "months": "2019-01,2019-02", "records": 7, "bad_records": 0, "accesses": 7, "distinct_names": 6, "names_without_entry": 1}
    found = daily_jobs.read_daily_table(spark, table)
    assert sorted((r.day // DAY - FEB1, r.f_block_id, r.month) for r in found.collect()) == [
        (-2, 11, "2019-01"), (-1, 12, "2019-01"), (-1, 12, "2019-02"), (0, 12, "2019-02"), (4, 13, "2019-02"),
    ]
    assert daily_jobs.read_daily_table(spark, table, (FEB1 + 1, FEB1 + 9)).count() == 1

    footprint(FEB1)
    first = {-2: (1, 100, 1), -1: (2, 300, 1), 0: (2, 300, 0)}
    assert rows() == first
    footprint(FEB1 + 5)
    assert rows() == first | {1: (1, 200, 0), 2: (1, 200, 0), 4: (1, 300, 1), 5: (1, 300, 0)}
    stays = rolling_jobs.read_footprint(spark, f"{tmp_path}/footprint", "stays").where("source = 'union'").collect()
    assert sorted((r.block, r.first_day - FEB1, r.last_day - FEB1) for r in stays) == [(11, -2, 0), (12, -1, 2)]
    with pytest.raises(ValueError, match="reaches day"):
        footprint(FEB1 + 5)

    # The second month is corrected; its days are counted anew from the state before them.
    put(tmp_path, "02", [(1, FEB1 + 1)])
    daily("2019-02")
    assert sorted(r.month for r in daily_jobs.read_daily_table(spark, table).collect()) == ["2019-01", "2019-01", "2019-02"]
    footprint(FEB1 + 3, "--back-to", str(FEB1))
    assert rows() == first | {1: (2, 300, 0), 2: (2, 300, 0), 3: (1, 100, 0)}
    # A state of other lookbacks cannot be carried on.
    with pytest.raises(ValueError, match="lookbacks"):
        footprint(FEB1 + 9, "--lookback", "3")


def test_broken_records_are_kept_apart_and_too_many_fail(spark, tmp_path, catalogues):
    files, datasets, *_ = catalogues
    put(tmp_path, "02", [(1, FEB1)] * 30)
    path = tmp_path / "opens" / "2019" / "02" / "a.json"
    path.write_text(path.read_text() + '{"data": {"file_lfn": "/store/2", "end_time": \n{"other": 1}\n')
    table = f"{tmp_path}/daily/working_set_cmssw"

    def daily(share):
        cli.main([
            "daily", "--log", f"cmssw={tmp_path}/opens/{{year}}/{{month}}/*.json", "--months", "2019-02", "--bad-share", share,
            "--datasets", datasets, "--files", files, "--out", f"{tmp_path}/daily",
        ])

    with pytest.raises(ValueError, match="2 of 32 records of cmssw are broken"):
        daily("0.01")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|published"):
        daily_jobs.read_daily_table(spark, f"{tmp_path}/daily/nothing")
    daily("0.1")
    assert daily_jobs.read_daily_table(spark, table).count() == 1
    bad = spark.read.parquet(f"{tmp_path}/daily/quarantine_cmssw").collect()
    assert sorted(r.record for r in bad) == ['{"data": {"file_lfn": "/store/2", "end_time": ', "{}"] and all(r.file.endswith("a.json") for r in bad)
    report = spark.read.parquet(f"{tmp_path}/daily/counts").first()
    assert (report.records, report.bad_records, report.accesses) == (32, 2, 30)


@pytest.mark.parametrize(
    ("template", "folder"),
    [("log/{year}/{month}/*/*.json", "log/2019/02/01/a.json"), ("l+g/x-{month}.{year}/?.json", "l+g/x-02.2019/a.json"),
     ("a b/time={year}-{month}-01_??h/p*.json", "a b/time=2019-02-01_03h/p.json")],
)
def test_the_month_of_a_folder(spark, tmp_path, template, folder):
    path = tmp_path / folder
    path.parent.mkdir(parents=True)
    path.write_text('{"data": {"file_lfn": "/store/1"}}\n')
    found, log = readers.read_log_months(spark, f"{tmp_path}/{template}", ["2019-01", "2019-02"], schemas.FILE_OPEN_REPORTS)
    assert found == ["2019-02"]
    assert [(r["data"].file_lfn, r.month) for r in log.collect()] == [("/store/1", "2019-02")]
    assert readers.read_log_months(spark, f"{tmp_path}/{template}", ["2018-01"], schemas.FILE_OPEN_REPORTS) == ([], None)


def test_a_month_is_read_off_the_file_of_the_scan(spark, tmp_path):
    record = json.dumps({"data": {"file_lfn": "/store/1", "end_time": 5}}) + "\n"
    for folder in ("my logs/x=2019-01-01", "my logs/x=2019-02-01"):
        path = tmp_path / folder / "a b.json"
        path.parent.mkdir(parents=True)
        path.write_text(record)
    template = f"{tmp_path}/my logs/x={{year}}-{{month}}-01/*"
    found, log = readers.read_log_months(spark, template, ["2019-01", "2019-02", "2019-03"], schemas.FILE_OPEN_REPORTS)
    assert found == ["2019-01", "2019-02"]
    opened = log.where(~readers.broken()).select("data.file_lfn", "month")
    # For a column of the metadata, each row would be copied whole.
    assert "_metadata" not in opened._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, opened.collect())) == [("/store/1", "2019-01"), ("/store/1", "2019-02")]
    # One task that reads several files.
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    assert sorted(r.month for r in log.coalesce(1).select("month").collect()) == found
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert readers.quarantined(log).count() == 0
