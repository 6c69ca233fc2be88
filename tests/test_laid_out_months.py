"""The logs that the months' queries lay out, and the join of their daily sets."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tidemark.operators import counts, daily


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_hashed_join_sorts_by_the_hash_first(no_broadcast):
    spark = no_broadcast
    opened = [("/store/1", 5.0), ("/store/1", 9.0), ("/store/2", 5.0), ("/store/9", 5.0), (None, 5.0)]
    log = spark.createDataFrame(opened, "file_lfn string, timestamp double")
    files = [("/store/1", 11, 1), ("/store/1", 11, 1), ("/store/2", 12, 1), ("/store/3", 13, 1), (None, 14, 1)]
    files = spark.createDataFrame(files, "f_logical_file_name string, f_block_id bigint, f_dataset_id bigint")
    datasets = spark.createDataFrame([(1, "/A/B-v1/AOD", 5)], "d_dataset_id bigint, d_dataset string, d_data_tier_id bigint")
    catalogue = daily.file_catalogue(files, datasets)
    seen = counts.Counts()
    df = daily.daily_blocks(log, catalogue, counts=seen, hashed=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The names have their first letters in common, so a sort by them would compare whole names.
    assert "Sort [xxhash64(file_lfn" in plan and "Sort [file_lfn" not in plan
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(tuple(r) for r in daily.daily_blocks(log, catalogue).collect()) and len(rows) == 2
    assert seen.values() == {"distinct_names": 5, "names_without_entry": 2}


def test_folders_of_the_logs_are_dates(spark, tmp_path):
    at = lambda *d: datetime.datetime(*d)
    lines = [(k, 1, 1, k % 7 + 1, "R", "O", d) for k, d in enumerate([at(1998, 6, 29), at(1998, 7, 2), None, *[at(1999, 3, 1 + i) for i in range(20)]])]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": ([(1, 1, "O", at(1998, 3, 1), "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(1, "a b", "Brand#5", "T", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    months = entry_module._lay_out_months(spark, str(tmp_path), f"{tmp_path}/out")
    assert months == ["1998-01", "1998-07", "1999-01"]
    folders = sorted(d for d in os.listdir(tmp_path / "out" / "cmssw") if d.startswith("folder="))
    assert folders == ["folder=1998-01-01", "folder=1998-07-01", "folder=1999-01-01", "folder=1999-01-02"]

    def records(name, folder):
        return spark.read.schema("data string").json(f"{tmp_path}/out/{name}/folder={folder}")

    # A record without a time lies in the last folder; what came first there lacks some records, the correction none.
    came, corrected = (records("cmssw", f"1999-01-0{n}") for n in (1, 2))
    assert (records("cmssw", "1998-01-01").count(), records("cmssw", "1998-07-01").count(), corrected.count()) == (1, 1, 21)
    assert 0 < came.count() < 21 and came.exceptAll(corrected).count() == 0
    assert records("fwjr", "1998-01-01").where(F.col("data").contains("/store/o/1")).count() == 1
