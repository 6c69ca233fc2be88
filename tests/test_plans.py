"""What the physical plans may and may not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import daily, rolling, sets, skew, transfers
from tidemark.plans import rolling_jobs, transfer_jobs
from tidemark.sources import schemas, sinks

FORBIDDEN = ("Python", "Cartesian", "NestedLoop", "MapInPandas")


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    if run:
        text = text.split("== Initial Plan ==")[0]
    return text


def exchanges(plan):
    return re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning)", plan)


def accesses(spark, n=4000):
    return spark.range(n).select(
        (F.col("id") % 50).alias("block"), (F.col("id") % 97).cast("int").alias("day"), F.lit("a").alias("source")
    )


def sizes(spark):
    return spark.range(50).select(F.col("id").alias("b_block_id"), F.col("id").cast("double").alias("b_block_size"))


def test_rolling_shuffles_once_for_all_lookbacks(no_broadcast):
    spark = no_broadcast
    few = rolling.rolling_footprint(accesses(spark), "block", sizes=sizes(spark), lookbacks=[7], axis=(0, 96))
    many = rolling.rolling_footprint(accesses(spark), "block", sizes=sizes(spark), lookbacks=range(1, 40), axis=(0, 96))
    a, b = plan_of(few), plan_of(many)
    assert not any(word in a + b for word in FORBIDDEN)
    assert len(exchanges(a)) == len(exchanges(b))
    # Distinct accesses; the join with sizes on both sides; daily sums; running sums. The window
    # per item runs on the partitioning of the join.
    assert len(exchanges(a)) == 5


def test_rolling_never_gathers_sets(spark):
    plan = plan_of(rolling.rolling_footprint(accesses(spark), "block", scope=["source"], lookbacks=[7]))
    assert "collect_set" not in plan and "collect_list" not in plan


def test_comparison_looks_at_the_accesses_once_if_days_are_given(no_broadcast):
    spark = no_broadcast
    days = spark.createDataFrame([("a", 1)], "source string, day int")
    df = rolling_jobs.source_comparison(accesses(spark), sizes(spark), axis=(0, 96), valid_days=days)
    plan = plan_of(df)
    assert not any(word in plan for word in FORBIDDEN)
    assert plan.count("Range (0, 4000") == 1


def transfer_tables(spark, n=30000):
    """Reads of which a third are of one file."""
    i = F.col("id")
    log = spark.range(n).select(
        F.concat(F.lit("/store/"), F.when(i % 3 == 0, 0).otherwise(i % 500)).alias("file_lfn"),
        ((i % 86400) * 1000 + 1548979200000).alias("start_time"),
        F.lit("c.edu").alias("client_domain"),
        F.concat(F.lit("h"), i).alias("client_host"),
        F.lit("s.ch").alias("server_domain"),
        F.lit("read").alias("operation"),
        F.lit(1).cast("bigint").alias("read_bytes"),
        F.lit(0).cast("bigint").alias("write_bytes"),
    )
    files = spark.range(500).select(
        F.concat(F.lit("/store/"), "id").alias("f_logical_file_name"),
        (F.col("id") % 3).alias("f_dataset_id"),
        (F.col("id") % 20).alias("f_block_id"),
    )
    datasets = spark.range(3).select(F.col("id").alias("d_dataset_id"))
    blocks = spark.range(20).select(
        F.col("id").alias("b_block_id"), F.concat(F.lit("B"), "id").alias("b_block_name")
    )
    replicas = blocks.select(
        (F.col("b_block_id") + F.lit(1548979200.0)).alias("now_sec"),
        F.col("b_block_name").alias("block_name"),
        F.lit("T1_US_X").alias("node_name"),
    )
    return log, files, datasets, blocks, replicas


def test_a_hot_file_is_split_by_the_join(no_broadcast):
    spark = no_broadcast
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = transfer_jobs.monthly_transfers(*transfer_tables(spark))
        rows = df.collect()
        plan = plan_of(df, run=True)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in rows] == [("2019-02", "eu", "us", True, 30000)]
    assert "SortMergeJoin(skew=true) [file_lfn" in plan
    assert not any(word in plan for word in FORBIDDEN)


def test_rows_of_a_hot_file_are_spread(no_broadcast):
    spark = no_broadcast
    log, *rest = transfer_tables(spark)
    hot = skew.frequent_keys(log, "file_lfn", 0.1)
    assert [r.file_lfn for r in hot.collect()] == ["/store/0"]
    df = transfer_jobs.monthly_transfers(log, *rest, hot_files=hot)
    assert [tuple(r) for r in df.collect()] == [("2019-02", "eu", "us", True, 30000)]
    catalogue = transfers.file_blocks(*rest[:2])
    reads = transfers.read_accesses(log)
    joined = skew.spread_join(reads, catalogue, "file_lfn", "f_logical_file_name", hot)
    plan = plan_of(joined)
    assert "_salt" in plan and "SortMergeJoin [" in plan and "BroadcastHashJoin [file_lfn" in plan
    plain = reads.join(catalogue, F.col("file_lfn") == F.col("f_logical_file_name")).drop("f_logical_file_name")
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0
    # Where the rows of the hot file end up: no partition has much more than its share.
    counts = joined.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes_ = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in counts) == sum(sizes_) == 30000
    assert max(sizes_) < 1.3 * 30000 / len(sizes_)


def test_copies_of_one_hot_row_are_spread(no_broadcast):
    spark = no_broadcast
    left = spark.range(0, 20000, 1, 64).select(F.concat(F.lit("a"), (F.col("id") < 0).cast("int")).alias("k"))
    right = spark.createDataFrame([("a0", 1), ("b", 2)], "r string, v int")
    hot = spark.createDataFrame([("a0",)], "h string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.spread_join(left, right, "k", "r", hot)
        counts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(counts) == 20000 and len(counts) == 4 and max(counts) < 10000


def test_spread_join_is_an_inner_join_whatever_is_called_hot(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("x", 3), (None, 4)], "k string, n int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), ("c", 30)], "r string, v int")
    expected = sorted([("a", 1, 10), ("a", 1, 10), ("b", 2, 20), ("b", 2, 21)])
    for names in ([], ["a"], ["b", "x", "nowhere"], ["a", "a", None, "b"]):
        hot = spark.createDataFrame([(n,) for n in names], "h string")
        got = skew.spread_join(left, right, "k", "r", hot)
        assert got.columns == ["k", "n", "v"]
        assert sorted(tuple(r) for r in got.collect()) == expected


def test_the_log_meets_the_catalogue_once(no_broadcast):
    spark = no_broadcast
    log, *rest = transfer_tables(spark)
    plan = plan_of(transfer_jobs.monthly_transfers(log, *rest))
    joins = re.findall(r"SortMergeJoin \[(\w+)", plan)
    assert joins.count("file_lfn") == 1
    # The reads come to the replicas already summed per block and region pair.
    assert set(joins) == {"file_lfn", "f_block_id", "f_dataset_id", "snapshot_date"}


def test_reads_are_filtered_in_the_scan(spark, tmp_path):
    log, *rest = transfer_tables(spark, 100)
    log.write.parquet(f"{tmp_path}/log")
    plan = plan_of(transfers.read_accesses(spark.read.parquet(f"{tmp_path}/log")))
    assert "EqualTo(operation,read)" in plan


def test_daily_sets_shrink_before_the_catalogue(no_broadcast):
    spark = no_broadcast
    log = spark.range(1000).select(
        F.concat(F.lit("/store/"), F.col("id") % 2).alias("file_lfn"), F.col("id").alias("timestamp"), F.lit("S").alias("site_name")
    )
    files = spark.createDataFrame([("/store/1", 1, 7)], "f_logical_file_name string, f_dataset_id bigint, f_block_id bigint")
    datasets = spark.createDataFrame(
        [(1, "/A/B-v1/AOD", 3)], "d_dataset_id bigint, d_dataset string, d_data_tier_id bigint"
    )
    df = daily.daily_blocks(log, daily.file_catalogue(files, datasets), ["site_name"])
    plan = plan_of(df)
    below_join = plan.split("SortMergeJoin [file_lfn")[1]
    assert below_join.index("HashAggregate") < below_join.index("Range")
    assert [r.f_block_id for r in df.collect()] == [7]


def test_a_bucketed_catalogue_is_not_shuffled(no_broadcast):
    spark = no_broadcast
    log = spark.range(1000).select(
        F.concat(F.lit("/store/"), F.col("id") % 20).alias("file_lfn"), F.col("id").alias("timestamp")
    )
    files = spark.range(20).select(
        F.concat(F.lit("/store/"), "id").alias("f_logical_file_name"),
        F.col("id").alias("f_block_id"),
        F.lit(1).alias("d_data_tier_id"),
        F.lit("c").alias("input_campaign"),
    )
    df = None
    for _ in range(2):  # the second time finds the table
        catalogue = sinks.bucketed_once(files, "file_catalogue_test", "f_logical_file_name", 4)
        df = daily.daily_blocks(log, catalogue)
    plan = plan_of(df)
    assert "Bucketed: true" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(f_logical_file_name", plan)) == 0
    assert len(re.findall(r"Exchange hashpartitioning\(file_lfn", plan)) == 1
    assert sorted(r.f_block_id for r in df.collect()) == list(range(20))


def test_arrays_take_one_shuffle(no_broadcast):
    arrays = sets.to_arrays(accesses(no_broadcast), ["day"], "block", "blocks", pieces=1)
    plan = plan_of(arrays, run=True)
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning\(day#\d+", plan)) == 1


def test_lookup_schemas_are_declared(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"file_lfn": "/store/1"}}\n')
    df = spark.read.schema(schemas.FILE_OPEN_REPORTS).json(f"{tmp_path}/a.json")
    assert df.select("data.*").columns == ["file_lfn", "end_time", "app_info", "site_name"]


def rows_scanned(df, n):
    """How often the ``n`` input rows were read, by Spark's own metrics of the plan that ran."""
    df.collect()

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage")):
            node = node.plan()
        if node.nodeName().startswith("ReusedExchange"):
            return
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for seq in (node.children(), node.subqueries()):
            for i in range(seq.size()):
                walk(seq.apply(i))

    found = []
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found) / n


def test_an_axis_from_the_data_costs_no_scan(no_broadcast, tmp_path):
    spark = no_broadcast
    accesses(spark).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert rows_scanned(rolling.rolling_footprint(log, "block", lookbacks=[7], sizes=sizes(spark)), 4000) == 1
    compared = rolling_jobs.source_comparison(log, sizes(spark))
    assert rows_scanned(compared, 4000) == 2


def test_a_fixed_axis_reaches_the_scan_of_daily_tables(spark, tmp_path):
    days = spark.range(40).select(
        (F.col("id") * 86400).alias("day"), F.lit(1).alias("d_data_tier_id"), F.col("id").alias("f_block_id")
    )
    days.write.parquet(f"{tmp_path}/daily")
    table = rolling_jobs.DailyTable(spark.read.parquet(f"{tmp_path}/daily"), "f_block_id")
    tiers = spark.createDataFrame([(1, "AOD")], "id int, data_tier string")
    series = rolling_jobs.aod_comparison({"a": table}, tiers, sizes(spark), axis=(10, 20))
    assert "GreaterThanOrEqual(day,864000), LessThan(day,1814400)" in plan_of(series).replace("PushedFilters", "\n")
    assert {r.day for r in series.collect()} == set(range(10, 21))


def test_a_total_is_shuffled_as_its_sources_are(no_broadcast):
    """Both rows of an access come from one, behind the shuffles; these are as many as the session has partitions, whatever their size."""
    rows = accesses(no_broadcast).selectExpr("'a' as source", "block", "day").distinct()
    text = plan_of(rolling.rolling_footprint(rows, "block", scope=["source"], sizes=sizes(no_broadcast), lookbacks=[7], axis=(1, 50), total="all"))
    window = text.index("lag(_day")
    dealt = text.index("REPARTITION_BY_NUM")
    assert "Exchange" not in text[window : text.index("Join")]
    assert "Generate explode" in text[window:dealt] and "SortMergeJoin" not in text


def test_a_state_is_carried_on_with_one_sort(no_broadcast):
    from pyspark.sql.types import LongType

    from tidemark.operators import stay_state

    state = stay_state.empty_state(no_broadcast, "block", LongType(), {}, [7, 30], 0)
    step = stay_state.extend(state, accesses(no_broadcast), 50)
    for df in (step.rows, step.ended, step.state.open):
        assert plan_of(df).count("Sort [") == 1
