from __future__ import annotations

import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.plans import daily_jobs, sampling
from tidemark.sources import adapters, readers, schemas, sinks


def write_log(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as out:
        out.writelines(json.dumps({"data": r}) + "\n" for r in records)


def csv_row(schema, **values):
    return ",".join(str(values.get(f.name, "null")) for f in schema.fields)


@pytest.fixture
def catalogue(tmp_path):
    datasets = tmp_path / "datasets.csv"
    datasets.write_text(
        "\n".join([
            csv_row(schemas.DATASETS, d_dataset_id=1, d_dataset="/A/Run2016F-23Sep2016-v1/AOD", d_data_tier_id=10),
            csv_row(schemas.DATASETS, d_dataset_id=3000000000, d_dataset="/B/Summer-PU/RAW", d_data_tier_id=20),
        ]) + "\n"
    )
    files = tmp_path / "files.csv"
    files.write_text(
        "\n".join(
            csv_row(schemas.FILES, f_file_id=i, f_logical_file_name=f"/store/{i}", f_dataset_id=d, f_block_id=b)
            for i, d, b in [(1, 1, 100), (2, 1, 100), (3, 1, 101), (4, 3000000000, 200), (5, 99, 300)]
        ) + "\n"
    )
    return str(datasets), str(files)


def daily(spark, tmp_path, catalogue, source, records):
    write_log(tmp_path / source / "2020" / "01" / "02" / "part.json.gz", records)
    template = f"{tmp_path}/{source}/{{dates}}/*.json.gz"
    daily_jobs.run_daily(spark, {source: template}, *catalogue, f"{tmp_path}/out", dates="2020/*/*", arrays=True, replace=True)
    table = spark.read.parquet(f"{tmp_path}/out/working_set_{source}")
    assert {r.piece for r in table.collect()} == {0}
    return table.drop("piece")


def test_daily_file_opens(spark, tmp_path, catalogue):
    t = 1550000000
    records = [
        {"file_lfn": "/store/1", "end_time": t, "app_info": "a:crab:b", "site_name": "S"},
        {"file_lfn": "/store/2", "end_time": t + 5, "app_info": "a:crab:b", "site_name": "S"},
        {"file_lfn": "/store/3", "end_time": t, "app_info": "a:crab:b", "site_name": "S"},
        {"file_lfn": "/store/3", "end_time": t, "app_info": "z", "site_name": "S"},
        {"file_lfn": "/store/4", "end_time": t, "site_name": None},
        {"file_lfn": "/store/5", "end_time": t, "site_name": "S"},  # its dataset is unknown
        {"file_lfn": "/user/1", "end_time": t, "site_name": "S"},
        {"end_time": t},
    ]
    got = daily(spark, tmp_path, catalogue, "cmssw", records)
    assert got.columns == [
        "day", "input_campaign", "d_data_tier_id", "site_name", "is_crab", "working_set_blocks",
    ]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted(
        [
            (1549929600, "Run2016F-23Sep2016", 10, "S", True, [100, 101]),
            (1549929600, "Run2016F-23Sep2016", 10, "S", False, [101]),
            (1549929600, "Summer", 20, None, None, [200]),
        ],
        key=str,
    )


def test_daily_batch_jobs(spark, tmp_path, catalogue):
    job = {
        "DESIRED_CMSDataset": "/A/Run2016F-23Sep2016-v1/AOD",
        "RecordTime": 1550000000500,
        "Site": "S",
        "CMS_SubmissionTool": "crab3",
        "Status": "Completed",
    }
    records = [job, job, job | {"Status": "Running"}, job | {"DESIRED_CMSDataset": None}, job | {"Status": None}]
    got = daily(spark, tmp_path, catalogue, "classads", records)
    assert [tuple(r) for r in got.collect()] == [(1549929600, "Run2016F-23Sep2016", 10, [1])]


def test_daily_remote_accesses(spark, tmp_path, catalogue):
    record = {"file_lfn": "/store/1", "end_time": 1550000000999, "client_domain": "a.ch", "vo": "cms"}
    records = [
        record,
        record | {"client_domain": "[::1]", "file_lfn": "/store/3"},
        record | {"client_domain": None},
        record | {"vo": "other", "file_lfn": "/store/4"},
    ]
    got = daily(spark, tmp_path, catalogue, "xrootd", records)
    rows = sorted(((r.client_domain or "", r.working_set_blocks) for r in got.collect()))
    assert rows == [("", [100, 101]), ("a.ch", [100])]


def test_daily_job_reports(spark, tmp_path, catalogue):
    record = {
        "meta_data": {"jobstate": "success", "ts": 1550000000},
        "steps": [{"site": "S"}, {"site": "T"}],
        "LFNArray": ["/store/1", "/store/unmerged/1", "/x/1", "/store/4"],
    }
    records = [
        record,
        record | {"meta_data": {"jobstate": "failed", "ts": 1550000000}, "LFNArray": ["/store/3"]},
        record | {"steps": [], "LFNArray": ["/store/3"]},
        record | {"LFNArray": None},
    ]
    got = daily(spark, tmp_path, catalogue, "fwjr", records)
    rows = sorted((r.site_name or "", r.d_data_tier_id, r.working_set_blocks) for r in got.collect())
    assert rows == [("", 10, [101]), ("S", 10, [100]), ("S", 20, [200])]


def test_all_sources_replace_their_tables(spark, tmp_path, catalogue):
    record = {"file_lfn": "/store/1", "end_time": 1550000000, "app_info": "z", "site_name": "S"}
    write_log(tmp_path / "opens" / "a.json.gz", [record])
    logs = {"cmssw": f"{tmp_path}/opens/{{dates}}.json.gz"}
    kept = {"dates": "*", "catalogue_path": f"{tmp_path}/files"}
    daily_jobs.run_daily(spark, logs, *catalogue, f"{tmp_path}/all", **kept)
    with pytest.raises(AnalysisException, match="already exists"):
        daily_jobs.run_daily(spark, logs, *catalogue, f"{tmp_path}/all", **kept)
    daily_jobs.run_daily(spark, logs, *catalogue, f"{tmp_path}/all", **kept, replace=True)
    assert spark.read.parquet(f"{tmp_path}/files").count() == 4
    assert spark.read.parquet(f"{tmp_path}/all/working_set_cmssw").count() == 1


def test_other_layouts_group_by_site_and_tool(spark, catalogue):
    log = spark.createDataFrame(
        [("/A/Run2016F-23Sep2016-v1/AOD", 1550000000500, "S", "crab3", "Completed")],
        schemas.BATCH_JOB_ADS["data"].dataType,
    )
    datasets = readers.read_catalogue(spark, catalogue[0], schemas.DATASETS)
    got = daily_jobs.daily_working_set("classads", log, datasets, keys=["CMS_SubmissionTool", "site_name"], pieces=1)
    assert [tuple(r) for r in got.collect()] == [
        (1549929600, "Run2016F-23Sep2016", 10, "crab3", "S", 0, [1])
    ]


def test_catalogue_read_is_strict(spark, tmp_path, catalogue):
    df = readers.read_catalogue(spark, catalogue[0], schemas.DATASETS)
    assert {r.d_dataset_id for r in df.collect()} == {1, 3000000000}
    assert df.where("d_prep_id is null").count() == 2
    bad = tmp_path / "bad.csv"
    bad.write_text("notanumber,x\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_catalogue(spark, str(bad), schemas.table("a bigint, b string")).collect()


def test_positions_prune_the_scan(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(csv_row(schemas.BLOCKS, b_block_id=7, b_dataset_id=8, b_block_size=9) + "\n")
    blocks = readers.read_catalogue(spark, str(path), schemas.BLOCKS)
    got = readers.select_positions(blocks, [0, 5], ["block_id", "block_size"])
    assert [tuple(r) for r in got.collect()] == [(7, 9.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "b_block_size" in plan and "b_dataset_id" not in plan.split("ReadSchema")[-1]


def test_headered_tiers(spark, tmp_path):
    path = tmp_path / "tiers.csv"
    path.write_text("id,data_tier\n1,AOD\n2,RAW\n")
    got = readers.read_catalogue(spark, str(path), schemas.TIER_NAMES, header=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "AOD"), (2, "RAW")]


def test_twenty_tables_without_narrow_integers():
    assert len(schemas.CATALOGUE_TABLES) == 20
    widths = {name: len(s.fields) for name, s in schemas.CATALOGUE_TABLES.items()}
    assert sorted(widths.values()) == sorted(
        [5, 7, 2, 4, 16, 11, 17, 3, 9, 2, 3, 5, 28, 11, 27, 44, 28, 15, 3, 3]
    )
    kinds = {f.dataType.simpleString() for s in schemas.CATALOGUE_TABLES.values() for f in s.fields}
    assert kinds == {"bigint", "double", "string"}


def test_only_missing_paths_are_skipped(spark, tmp_path):
    assert readers.read_if_present(lambda: spark.read.parquet(f"{tmp_path}/no")) is None
    with pytest.raises(AnalysisException):
        readers.read_if_present(lambda: spark.range(1).select("no_such_column"))


def test_format_choice():
    assert readers.choose_format("/a/avro/x.json") == "avro"
    assert readers.choose_format("/a/x.json.gz") == "json"
    assert readers.choose_format("/a/x", "csv") == "csv"
    with pytest.raises(ValueError):
        readers.choose_format("/a/x")
    with pytest.raises(ValueError):
        readers.choose_format("/a/x", "orc")
    assert readers.strip_prefix("/mnt/cluster/a/b", "/mnt/cluster") == "/a/b"


def test_sample_to_files(spark, tmp_path):
    source = f"{tmp_path}/json_source"
    spark.range(50).select(F.struct("id", F.lit("x").alias("s")).alias("data")).write.json(source)
    sampling.run_sample(spark, f"/mnt{source}", f"{tmp_path}/out", n=1000, prefix="/mnt")
    back = spark.read.json(f"{tmp_path}/out")
    assert back.select("data.id").distinct().count() == 50
    sampling.run_sample(spark, source, f"{tmp_path}/out", n=5, out_format="parquet", seed=3)
    assert spark.read.parquet(f"{tmp_path}/out").count() < 30
    with pytest.raises(ValueError):
        sampling.run_sample(spark, source, f"{tmp_path}/out", out_format="pickle")


def test_samples_of_an_empty_source_and_exact_samples(spark):
    assert sampling.sample_rows(spark.range(0)).count() == 0
    assert sampling.sample_exactly(spark.range(500), 20, seed=1).distinct().count() == 20
    assert sampling.sample_exactly(spark.range(5), 20).count() == 5
    assert sampling.sample_exactly(spark.range(0), 20).count() == 0 and sampling.sample_exactly(spark.range(9), 0).count() == 0
    many = sampling.sample_exactly(spark.range(300_000), 100_000, seed=3)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan
    assert many.distinct().count() == 100_000 and 140_000 < many.agg({"id": "avg"}).first()[0] < 160_000


def test_dump_text(spark, tmp_path):
    spark.range(3).select("id", F.lit(None).cast("string").alias("n")).write.parquet(f"{tmp_path}/p")
    sinks.dump_text(spark, f"{tmp_path}/p", f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == [
        '{"id":0}', '{"id":1}', '{"id":2}',
    ]


def test_partition_overwrite_leaves_other_months(spark, tmp_path):
    out = f"{tmp_path}/matrix"
    frame = lambda rows: spark.createDataFrame(rows, schemas.TRANSFER_MATRIX)
    sinks.write_table(frame([("us", "eu", True, 1, "2019-02"), ("us", "eu", True, 2, "2019-03")]), out, ["year_month"])
    sinks.write_table(frame([("us", "eu", True, 9, "2019-03")]), out, ["year_month"])
    got = readers.read_months(spark, out, schemas.TRANSFER_MATRIX)
    assert sorted((r.year_month, r.total_read_bytes) for r in got.collect()) == [("2019-02", 1), ("2019-03", 9)]
    march = readers.read_months(spark, out, schemas.TRANSFER_MATRIX, ["2019-03"])
    assert march.count() == 1
    assert "PartitionFilters: [isnotnull(year_month" in march._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(AnalysisException):
        sinks.write_table(frame([]), out, replace=False)


def test_build_once(spark, tmp_path):
    path = f"{tmp_path}/lookup"
    assert sinks.build_once(spark.range(3), path).count() == 3
    assert sinks.build_once(spark.range(9), path).count() == 3
    sinks._stamp(spark, path, "being written")  # as a lost job leaves it
    assert sinks.build_once(spark.range(9), path).count() == 9
    assert sinks.build_once(spark.range(4), path, refresh=True).count() == 4


def test_adapter_tolerates_broken_lines(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"data": {"file_lfn": "/store/1", "end_time": 5}}\nnot json\n{"other": 1}\n')
    log = readers.read_log(spark, str(path), schemas.FILE_OPEN_REPORTS)
    assert [r.file_lfn for r in adapters.file_opens(log).collect()] == ["/store/1"]
