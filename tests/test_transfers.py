from __future__ import annotations

import json

import pytest

from tidemark.operators import skew
from tidemark.plans import transfer_jobs
from tidemark.sources import published, schemas

FEB1 = 1548979200  # 2019-02-01 00:00 UTC
DAY = 86400


def log_row(lfn="/store/1", at=FEB1 + 60, client="x.edu", server="y.ch", size=10, op="read", host="h", row=0):
    return (lfn, at * 1000, client, host, server, op, size, 0, row)


LOG = (
    "file_lfn string, start_time bigint, client_domain string, client_host string, server_domain string, "
    "operation string, read_bytes bigint, write_bytes bigint, row bigint"
)


@pytest.fixture
def catalogue(spark):
    files = spark.createDataFrame(
        [("/store/1", 1, 100), ("/store/2", 1, 100), ("/store/3", 9, 101)],
        "f_logical_file_name string, f_dataset_id bigint, f_block_id bigint",
    )
    datasets = spark.createDataFrame([(1,), (1,)], "d_dataset_id bigint")
    blocks = spark.createDataFrame([(100, "B"), (101, "C")], "b_block_id bigint, b_block_name string")
    return files, datasets, blocks


def matrix(spark, catalogue, log, replicas, **options):
    replica_df = spark.createDataFrame(replicas, "now_sec double, block_name string, node_name string")
    df = transfer_jobs.monthly_transfers(spark.createDataFrame(log, LOG), *catalogue, replica_df, **options)
    return sorted((tuple(r) for r in df.collect()), key=str)


US_NODE = [(float(FEB1 + 3600), "B", "T1_US_SITE_Buffer")]


def test_available_at_the_client(spark, catalogue):
    got = matrix(spark, catalogue, [log_row(), log_row(client="z.fr", size=7)], US_NODE)
    assert got == [("2019-02", "eu", "eu", False, 7), ("2019-02", "eu", "us", True, 10)]


def test_equal_reads_in_one_second_count_once_unless_rows_are_told_apart(spark, catalogue):
    log = [log_row(row=1), log_row(row=2, lfn="/store/2"), log_row(row=3, at=FEB1 + 61)]
    assert matrix(spark, catalogue, log, US_NODE) == [("2019-02", "eu", "us", True, 20)]
    assert matrix(spark, catalogue, log, US_NODE, row_id="row") == [("2019-02", "eu", "us", True, 30)]


def test_only_reads_on_the_snapshot_date_count(spark, catalogue):
    log = [log_row(), log_row(at=FEB1 + DAY, size=100), log_row(at=FEB1 + 40 * DAY, size=1000)]
    assert matrix(spark, catalogue, log, US_NODE) == [("2019-02", "eu", "us", True, 10)]
    assert matrix(spark, catalogue, log, US_NODE, carry_days=5) == [("2019-02", "eu", "us", True, 110)]


def test_snapshots_after_the_first_of_a_month(spark, catalogue):
    second = [(float(FEB1 + DAY), "B", "T1_US_SITE_Buffer")]
    log = [log_row(at=FEB1 + DAY)]
    assert matrix(spark, catalogue, log, second) == []
    assert matrix(spark, catalogue, log, second, first_of_month=False) == [("2019-02", "eu", "us", True, 10)]


def test_a_later_snapshot_replaces_the_earlier_one(spark, catalogue):
    replicas = [*US_NODE, (float(FEB1 + 2 * DAY), "C", "T2_CH_SITE")]
    log = [log_row(at=FEB1 + d * DAY, size=10**d) for d in range(4)]
    got = matrix(spark, catalogue, log, replicas, first_of_month=False, carry_days=10)
    assert got == [("2019-02", "eu", "us", True, 11)]


def test_replicas_do_not_multiply_reads(spark, catalogue):
    replicas = [*US_NODE, *US_NODE, (float(FEB1), "B", "T2_CH_SITE"), (float(FEB1), "B", "X")]
    assert matrix(spark, catalogue, [log_row()], replicas) == [("2019-02", "eu", "us", True, 10)]


def test_what_is_left_out(spark, catalogue):
    log = [
        log_row(op="write"),
        log_row(op=None),
        log_row(client="1.2.3.4"),
        log_row(client=None),
        log_row(lfn="/store/3"),  # its dataset is unknown
        log_row(lfn="/store/9"),
        log_row(server="localhost", size=3),
        log_row(server="localhost", size=None),
    ]
    assert matrix(spark, catalogue, log, US_NODE) == [("2019-02", None, "us", True, 3)]


def test_reports(spark):
    rows = [
        ("us", "eu", True, 1, "2019-02"),
        ("us", "eu", False, 2, "2019-02"),
        ("eu", "us", False, 4, "2019-02"),
        (None, "us", False, 8, "2019-02"),
    ]
    df = spark.createDataFrame(rows, schemas.TRANSFER_MATRIX)
    overview = sorted(tuple(r) for r in transfer_jobs.overview(df).collect())
    assert overview == [
        ("2019-02", "eu", "us", 4, "from us to eu"),
        ("2019-02", "us", "eu", 3, "from eu to us"),
    ]
    split = transfer_jobs.cross_region(df, "eu", "us").collect()
    assert sorted((r.total_read_bytes, r.necessity) for r in split) == [
        (1, "block available in eu = unnecessary eu-us transfer"),
        (2, "block not available in eu = necessary eu-us transfer"),
    ]


def test_job_skips_months_without_input(spark, tmp_path):
    def csv(name, schema, *rows):
        lines = [",".join(str(r.get(f.name, "null")) for f in schema.fields) for r in rows]
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    def log(month, at):
        path = tmp_path / "log" / "2019" / month / "01" / "a.json"
        path.parent.mkdir(parents=True)
        names = schemas.TRANSFER_REPORTS["data"].dataType.names
        path.write_text(json.dumps({"data": dict(zip(names, log_row(at=at)))}) + "\n")

    log("02", FEB1)
    log("03", FEB1 + 28 * DAY)  # no snapshot for March
    csv("rep/time=2019-02-01_03h07m10s/part", schemas.REPLICAS,
        {"now_sec": FEB1 + 5, "block_name": "B", "node_name": "T2_CH_SITE"})
    csv("rep/time=2019-04-01_03h07m10s/part", schemas.REPLICAS, {"now_sec": FEB1, "block_name": "B"})
    months = transfer_jobs.run_transfers(
        spark,
        f"{tmp_path}/log/{{year}}/{{month}}/*/*.json",
        f"{tmp_path}/rep/time={{year}}-{{month}}-01_??h??m??s/part",
        csv("files", schemas.FILES, {"f_logical_file_name": "/store/1", "f_dataset_id": 1, "f_block_id": 100}),
        csv("datasets", schemas.DATASETS, {"d_dataset_id": 1}),
        csv("blocks", schemas.BLOCKS, {"b_block_id": 100, "b_block_name": "B"}),
        f"{tmp_path}/out",
        [f"2019-{m:02}" for m in range(1, 6)],
    )
    assert months == ["2019-02"]
    got = transfer_jobs.load_transfers(spark, f"{tmp_path}/out").collect()
    assert [tuple(r) for r in got] == [("eu", "us", False, 10, "2019-02")]


def test_a_run_that_fails_leaves_the_published_months(spark, tmp_path):
    def csv(name, schema, *rows):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(",".join(str(r.get(f.name, "null")) for f in schema.fields) for r in rows) + "\n")
        return str(path)

    def log(month, at):
        path = tmp_path / "log" / "2019" / month / "01" / "a.json"
        path.parent.mkdir(parents=True)
        names = schemas.TRANSFER_REPORTS["data"].dataType.names
        path.write_text(json.dumps({"data": dict(zip(names, log_row(at=at)))}) + "\n")

    def run(*months):
        return transfer_jobs.run_transfers(
            spark, f"{tmp_path}/log/{{year}}/{{month}}/*/*.json", f"{tmp_path}/rep/time={{year}}-{{month}}-01/part", *catalogue, f"{tmp_path}/out", months
        )

    catalogue = (
        csv("files", schemas.FILES, {"f_logical_file_name": "/store/1", "f_dataset_id": 1, "f_block_id": 100}),
        csv("datasets", schemas.DATASETS, {"d_dataset_id": 1}),
        csv("blocks", schemas.BLOCKS, {"b_block_id": 100, "b_block_name": "B"}),
    )
    for month, at in (("02", FEB1), ("03", FEB1 + 28 * DAY)):
        log(month, at)
        csv(f"rep/time=2019-{month}-01/part", schemas.REPLICAS, {"now_sec": at + 5, "block_name": "B", "node_name": "T2_CH_SITE"})

    def rows():
        return sorted(map(tuple, transfer_jobs.load_transfers(spark, f"{tmp_path}/out").collect()), key=lambda r: r[-1])

    assert run("2019-02", "2019-03") == ["2019-02", "2019-03"]
    before = rows()
    assert [r[-1] for r in before] == ["2019-02", "2019-03"]
    sketches = published.read_published(spark, f"{tmp_path}/out/sketches")
    assert [r.file_lfn for r in skew.sketched_keys(sketches, "file_lfn").collect()] == ["/store/1"] and sketches.first().n_rows == 2
    csv("rep/time=2019-02-01/part", schemas.REPLICAS, {"now_sec": FEB1 + 5, "block_name": "B", "node_name": "T2_US_SITE"})
    csv("rep/time=2019-03-01/part", schemas.REPLICAS, {"now_sec": "no number", "block_name": "B", "node_name": "T2_CH_SITE"})
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ"):
        run("2019-02", "2019-03")
    assert rows() == before
    run("2019-02")
    after = rows()
    assert after != before and after[1:] == before[1:]
    assert len(transfer_jobs.load_transfers(spark, f"{tmp_path}/out", ["2019-03"]).collect()) == 1


def test_logs_by_month_are_laid_out_once_and_compressed(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e

    tables = {
        "lineitem": "select 1L l_orderkey, id l_partkey, 1L l_suppkey, int(id) l_linenumber, 2.0D l_quantity, 'R' l_returnflag, 'O' l_linestatus, "
        "cast(if(id = 1, '1997-12-31', '1997-12-30') as timestamp_ntz) l_shipdate from range(1, 4)",
        "orders": "select 1L o_orderkey, 1L o_custkey",
        "customer": "select 1L c_custkey, 1 c_nationkey",
        "supplier": "select 1L s_suppkey, 2 s_nationkey",
        "part": "select id p_partkey, 'p' p_name, 4 p_size from range(4)",
        "nation": "select 2 n_nationkey",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    root = str(tmp_path / "laid")
    monkeypatch.setattr(e, "_shared_path", lambda *_: root)
    wanted = []
    monkeypatch.setattr(e.transfer_jobs, "run_transfers", lambda *a: wanted.append(a[-1]))
    monkeypatch.setattr(e.transfer_jobs, "load_transfers", lambda *_: None)
    e.queries()["transfer_months_rerun"](spark, str(tmp_path))
    # The last day of a year lies in the next one's folder.
    assert wanted == [["1900-01", "1997-07", "1998-01"], ["1998-01"]]
    first, again = (spark.read.option("primitivesAsString", True).json(f"{root}/{v}/log/year=*/month=*").select("data.*") for v in ("first", "again"))
    assert sorted(r.read_bytes for r in first.collect()) == ["2000"] * 3
    (row,) = again.collect()
    assert row.read_bytes == "20000" and row.file_lfn == "/store/p/1/1"
    assert row.asDict() | {"read_bytes": "2000"} in [r.asDict() for r in first.collect()]
    for name in ("replicas", "files", "blocks"):
        parts = [p for p in (tmp_path / "laid" / name).rglob("part-*")]
        assert parts and all(p.name.endswith(".csv.gz") for p in parts)
