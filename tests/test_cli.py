from __future__ import annotations

import json

import pytest

from tidemark import cli
from tidemark.sources import schemas


def csv(path, schema, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(
        "\n".join(",".join(str(r.get(f.name, "null")) for f in schema.fields) for r in rows) + "\n"
    )
    return str(path)


def test_from_logs_to_the_comparison(spark, tmp_path):
    day = 17000
    opens = tmp_path / "opens" / "2020" / "a.json"
    opens.parent.mkdir(parents=True)
    opens.write_text(
        "".join(
            json.dumps({"data": {"file_lfn": f"/store/{i}", "end_time": (day + i) * 86400, "site_name": "S"}}) + "\n"
            for i in (1, 2)
        )
    )
    ads = tmp_path / "ads" / "2020" / "a.json"
    ads.parent.mkdir(parents=True)
    ads.write_text(
        json.dumps({"data": {"DESIRED_CMSDataset": "/A/B-v1/AOD", "RecordTime": day * 86400000, "Status": "Completed"}})
        + "\n"
    )
    files = csv(
        tmp_path / "files",
        schemas.FILES,
        *[{"f_logical_file_name": f"/store/{i}", "f_dataset_id": 1, "f_block_id": 10 + i} for i in (1, 2)],
    )
    datasets = csv(
        tmp_path / "datasets", schemas.DATASETS, {"d_dataset_id": 1, "d_dataset": "/A/B-v1/AOD", "d_data_tier_id": 5}
    )
    blocks = csv(
        tmp_path / "blocks",
        schemas.BLOCKS,
        *[{"b_block_id": 10 + i, "b_dataset_id": 1, "b_block_size": 100 * i} for i in (1, 2)],
    )
    tiers = tmp_path / "tiers.csv"
    tiers.write_text("id,data_tier\n5,AOD\n")
    cli.main([
        "daily",
        "--log", f"cmssw={tmp_path}/opens/{{dates}}/*.json",
        "--log", f"classads={tmp_path}/ads/{{dates}}/*.json",
        "--dates", "2020", "--datasets", datasets, "--files", files, "--out", f"{tmp_path}/daily",
    ])
    cli.main([
        "compare",
        "--daily", f"opens={tmp_path}/daily/working_set_cmssw",
        "--daily-datasets", f"ads={tmp_path}/daily/working_set_classads",
        "--blocks", blocks, "--tiers", str(tiers), "--lookback", "0",
        "--now", str((day + 4) * 86400), "--out", f"{tmp_path}/series", "--report", f"{tmp_path}/report",
    ])
    assert spark.read.parquet(f"{tmp_path}/report/counts").first().asDict() == {"rows_with_items": 8, "rows_without_size": 0}
    assert spark.read.parquet(f"{tmp_path}/report/missing_blocks").count() == 0
    fewer = csv(tmp_path / "fewer", schemas.BLOCKS, {"b_block_id": 11, "b_dataset_id": 1, "b_block_size": 100})
    cli.main([
        "compare", "--daily", f"opens={tmp_path}/daily/working_set_cmssw", "--blocks", fewer, "--tiers", str(tiers), "--now", str((day + 4) * 86400),
        "--out", f"{tmp_path}/series2", "--report", f"{tmp_path}/report2", "--show-from", "2016-07-19",
    ])
    # Rows from day 17001 on; the counts are of all days.
    assert spark.read.parquet(f"{tmp_path}/series2").agg({"day": "min"}).first()[0] == day + 1
    assert spark.read.parquet(f"{tmp_path}/report2/counts").first().asDict() == {"rows_with_items": 4, "rows_without_size": 2}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/report2/missing_blocks").collect()] == [("opens", 12)]
    series = spark.read.parquet(f"{tmp_path}/series")
    assert series.agg({"day": "max"}).first()[0] == day + 2
    shown = {(r.source, r.day - day): r.ws_size for r in series.where("n_items > 0").collect()}
    assert shown == {
        ("ads", 0): 300, ("opens", 1): 100, ("opens", 2): 200,
        ("union", 0): 300, ("union", 1): 100, ("union", 2): 200,
    }
    cli.main([
        "slice", "--daily", f"{tmp_path}/daily/working_set_cmssw", "--blocks", blocks, "--tiers", str(tiers), "--tier", "AOD",
        "--equal", "site_name=S", "--starts", "input_campaign=[AB]", "--lookback", "0", "--show-from", "2016-07-20",
        "--out", f"{tmp_path}/slice",
    ])
    rows = {r.day - day: (r.ws_size, r.recall_size) for r in spark.read.parquet(f"{tmp_path}/slice/series").collect()}
    assert rows == {1: (100, 100), 2: (200, 200)}
    assert spark.read.parquet(f"{tmp_path}/slice/shown").count() == 1
    assert spark.read.parquet(f"{tmp_path}/slice/mean_recall").first().mean_recall_tb == pytest.approx(150e-12)
    cli.main([
        "histograms", "--log", f"cmssw={tmp_path}/opens/{{dates}}/*.json", "--dates", "2020",
        "--datasets", datasets, "--files", files, "--out", f"{tmp_path}/sizes",
    ])
    groups = spark.read.parquet(f"{tmp_path}/sizes/groups").collect()
    assert sorted((r.day // 86400 - day, r.nblocks, r.njobs) for r in groups) == [(1, 1, 1), (2, 1, 1)]
    assert spark.read.parquet(f"{tmp_path}/sizes/histograms").count() == 20


def test_overview_sample_and_dump(spark, tmp_path):
    rows = [("us", "eu", True, 1, "2019-02"), ("us", "eu", False, 2, "2019-03")]
    matrix = spark.createDataFrame(rows, schemas.TRANSFER_MATRIX)
    matrix.write.partitionBy("year_month").parquet(f"{tmp_path}/matrix")
    cli.main(["overview", "--matrix", f"{tmp_path}/matrix", "--months", "2019-02", "--out", f"{tmp_path}/reports"])
    assert spark.read.parquet(f"{tmp_path}/reports/overview").count() == 1
    assert spark.read.parquet(f"{tmp_path}/reports/eu_us").count() == 1
    assert spark.read.parquet(f"{tmp_path}/reports/us_eu").count() == 0
    spark.range(9).write.json(f"{tmp_path}/json")
    cli.main(["sample", f"{tmp_path}/json", f"{tmp_path}/sample", "-n", "100"])
    assert spark.read.json(f"{tmp_path}/sample").count() == 9
    cli.main(["dump", f"{tmp_path}/matrix", f"{tmp_path}/text"])
    assert spark.read.text(f"{tmp_path}/text").count() == 2


def test_unknown_source():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["daily", "--log", "nosuch=/x", "--datasets", "d", "--files", "f", "--out", "o"])


def test_transfers_without_any_month_fail(spark, tmp_path):
    args = ["transfers", "--files", "x", "--datasets", "x", "--blocks", "x", "--months", "2019-07", "--out", f"{tmp_path}/out"]
    args += ["--log", f"{tmp_path}/log/{{year}}/{{month}}", "--replicas", f"{tmp_path}/replicas/{{year}}-{{month}}"]
    with pytest.raises(SystemExit, match="no month has input"):
        cli.main(args)
    cli.main([*args, "--allow-none"])


def test_days_are_numbers_or_dates():
    args = ["footprint", "--blocks", "b", "--tiers", "t", "--out", "o", "--first-day"]
    for text, day in (("17000", 17000), ("2016-07-18", 17000), ("1969-12-31", -1)):
        assert cli.parser().parse_args([*args, text]).first_day == day
    for text in ("2016-7", "2016-02-30", "soon", ""):
        with pytest.raises(SystemExit):
            cli.parser().parse_args([*args, text])
