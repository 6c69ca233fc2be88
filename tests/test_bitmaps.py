from __future__ import annotations

from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.operators import bitmaps, daily, sets

EDGES = [0, 1, 32767, 32768, 32769, 65536, -1, -5, -32768, -32769, 10**12, 7, 8]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, source string, x bigint")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_members_come_back(spark):
    rows = [("a", "s", i) for i in EDGES] * 2 + [("empty", "s", None), ("c", "s", None), ("c", "s", 5), (None, "s", 3)]
    made = bitmaps.to_bitmaps(frame(spark, rows), ["k"], "x")
    assert all(r.bits is None or len(r.bits) == 4096 for r in made.collect())
    want = [("a", i) for i in EDGES] + [("c", 5), (None, 3)]
    assert rows_of(bitmaps.to_members(made, ["k"], "x")) == sorted(want, key=str)
    assert rows_of(bitmaps.to_members(made, ["k"], "x", keep_empty=True)) == sorted([*want, ("empty", None)], key=str)
    assert dict(rows_of(bitmaps.sizes(made, ["k"]))) == {"a": len(EDGES), "c": 1, None: 1, "empty": 0}
    assert bitmaps.to_members(made.limit(0), ["k"], "x").collect() == []


ids = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(-70_000, 70_000)), max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ids)
def test_set_laws(spark, rows):
    made = bitmaps.to_bitmaps(frame(spark, rows), ["k", "source"], "x")
    per_set = {}
    for k, s, i in rows:
        per_set.setdefault(k, {}).setdefault(s, set()).add(i)
    union = bitmaps.union(made, ["k"])
    want = {(k, i) for k, by in per_set.items() for i in set().union(*by.values())}
    assert rows_of(bitmaps.to_members(union, ["k"], "x")) == sorted(want, key=str)
    assert dict(rows_of(bitmaps.union_sizes(made, ["k"]))) == {k: len(set().union(*by.values())) for k, by in per_set.items()}
    for n in (2, 3):
        common = {(k, i) for k, by in per_set.items() if len(by) == n for i in reduce(set.intersection, by.values())}
        got = {(k, i) for k, i in rows_of(bitmaps.to_members(bitmaps.intersection(made, ["k"], n), ["k"], "x")) if len(per_set[k]) == n}
        assert got == common


def test_a_large_group_is_many_bounded_rows(spark):
    members = spark.range(0, 200_000, 2).selectExpr("'one' as k", "id as x")
    made = bitmaps.to_bitmaps(members, ["k"], "x")
    assert made.count() == 8  # id 0 has a bucket of its own
    assert bitmaps.sizes(made, ["k"]).first().n_items == 100_000
    assert bitmaps.to_members(made, ["k"], "x").exceptAll(members).count() == 0
    assert sets.union_rows(bitmaps.to_members(made, ["k"], "x"), members).count() == 100_000


def test_ids_are_whole_numbers(spark):
    with pytest.raises(Exception, match="CAST|cast"):
        bitmaps.to_bitmaps(spark.createDataFrame([("a", "p")], "k string, x string"), ["k"], "x").collect()


def test_the_catalogue_is_reduced_before_its_shuffle(spark):
    files = spark.range(50_000).select(F.concat(F.lit("/store/"), "id").alias("f_logical_file_name"), F.col("id").alias("f_block_id"), F.lit("c").alias("input_campaign"), F.lit(1).alias("d_data_tier_id"))
    log = spark.range(900).select(F.concat(F.lit("/store/"), F.col("id") * 70).alias("file_lfn"), (F.col("id") % 3 * 86400).alias("timestamp"))
    log = log.union(spark.createDataFrame([(None, 5), ("/store/1", 5)], "file_lfn string, timestamp bigint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain, reduced = (daily.daily_blocks(log, files, reduced=r) for r in (False, True))
    assert rows_of(plain) == rows_of(reduced)
    known = bitmaps.name_filter(log, "file_lfn")
    assert 700 <= bitmaps.possible_names(files, "f_logical_file_name", known).count() <= 760  # 716 names are known
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    shuffled = plan.index("Exchange hashpartitioning(f_logical_file_name")
    assert "BroadcastHashJoin" in plan[shuffled:] and "BroadcastHashJoin" not in plan[:shuffled]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = bitmaps.name_filter(log, "file_lfn", 64)
    assert bitmaps.possible_names(files, "f_logical_file_name", few, 64).count() <= 50_000
    assert bitmaps.possible_names(files, "f_logical_file_name", bitmaps.name_filter(log.limit(0), "file_lfn")).count() == 0
