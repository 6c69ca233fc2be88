from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import daily, lookups, sets, skew
from tidemark.sources import sinks


def pairs(spark):
    rows = [([1, 2, 3], [2]), ([1, 2], [2, 3]), ([], [5]), ([3, 3, 1], [])]
    return spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")


def test_array_operators(spark):
    got = pairs(spark).select(
        sets.set_union("a", "b"), sets.set_difference("a", "b"), sets.set_intersection("a", "b"), sets.as_set("a")
    ).collect()
    assert [tuple(r) for r in got] == [
        ([1, 2, 3], [1, 3], [2], [1, 2, 3]),
        ([1, 2, 3], [1], [2], [1, 2]),
        ([5], [], [], []),
        ([1, 3], [1, 3], [], [1, 3]),
    ]


def test_set_laws(spark):
    a, b = F.col("a"), F.col("b")
    laws = [
        sets.set_union(a, b) == sets.set_union(b, a),
        sets.set_intersection(a, b) == sets.set_intersection(b, a),
        sets.set_union(sets.set_difference(a, b), sets.set_intersection(a, b)) == sets.as_set(a),
        sets.set_intersection(sets.set_difference(a, b), b) == F.array().cast("array<bigint>"),
    ]
    assert all(all(row) for row in pairs(spark).select(*laws).collect())


@pytest.mark.parametrize(
    "bulk, single",
    [
        (sets.union_rows, sets.set_union),
        (sets.difference_rows, sets.set_difference),
        (sets.intersection_rows, sets.set_intersection),
    ],
)
def test_long_form_equals_array_form(spark, bulk, single):
    df = pairs(spark).withColumn("k", F.monotonically_increasing_id())
    side = lambda c: df.select("k", F.explode(c).alias("item"))
    long = sorted(tuple(r) for r in bulk(side("a"), side("b")).collect())
    short = df.select("k", F.explode(single("a", "b")).alias("item")).collect()
    assert long == sorted(tuple(r) for r in short)


def test_union_of_many_sets(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [2, 5]), (1, []), (2, [])], "day int, s array<int>")
    got = sets.daily_union(df, ["day"], "s", "item").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (1, 2), (1, 5)]


def test_null_keys_and_null_items(spark):
    df = spark.createDataFrame(
        [(None, 1), (None, 1), ("a", None), ("b", 2), ("b", None)], "k string, item int"
    )
    got = sets.to_arrays(df, ["k"], "item", "items").collect()
    assert sorted((r.k or "", r["items"]) for r in got) == [("", [1]), ("a", []), ("b", [2])]
    back = sets.to_members(sets.to_arrays(df, ["k"], "item", "items"), ["k"], "items", "item")
    assert sorted((r.k or "", r.item or 0) for r in back.collect()) == [("", 1), ("a", 0), ("b", 2)]


def test_the_form_of_arrays_does_not_depend_on_the_number_of_members(spark):
    rows = [(None, i) for i in [*range(1000), None]] + [("small", i) for i in range(3)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, item int")
    got = {r.k: r["items"] for r in sets.to_arrays(df, ["k"], "item", "items", pieces=1).collect()}
    assert got == {None: list(range(1000)), "small": [0, 1, 2], "none": []}
    arrays = sets.to_arrays(df, ["k"], "item", "items", pieces=10)
    assert arrays.columns == ["k", "piece", "items"]
    got = arrays.collect()
    large = [r for r in got if r.k is None]
    assert sorted(r.piece for r in large) == list(range(10)) and max(len(r["items"]) for r in large) < 200
    assert [(r.piece, r["items"]) for r in got if r.k == "none"] == [(0, [])]
    assert sum(len(r["items"]) for r in got if r.k == "small") == 3
    back = sets.to_members(arrays, ["k"], "items", "item").collect()
    assert sorted((r.k or "", -1 if r.item is None else r.item) for r in back) == sorted(
        [("", i) for i in range(1000)] + [("small", i) for i in range(3)] + [("none", -1)]
    )


def test_expansion_keeps_datasets_without_blocks(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, None)], "day int, ds int")
    blocks = spark.createDataFrame([(10, 100), (10, 101), (11, 101)], "d int, b int")
    expanded = sets.expand_members(members, "ds", blocks, "d", "b")
    got = sets.to_arrays(expanded, ["day"], "b", "blocks", pieces=1).collect()
    assert sorted((r.day, r.blocks) for r in got) == [(1, [100, 101]), (2, []), (3, [])]


def test_bag_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "day int, site string")
    b = spark.createDataFrame([(2, True)], "day int, flag boolean")
    got = sets.bag_union(a, b).orderBy("day").collect()
    assert [r.asDict() for r in got] == [
        {"day": 1, "site": "x", "flag": None},
        {"day": 2, "site": None, "flag": True},
    ]


def test_unknown_tier(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "d_data_tier_id bigint")
    tiers = spark.createDataFrame([(1, "AOD")], "id bigint, data_tier string")
    with pytest.raises(Exception, match="unknown data tier id: (9|NULL)"):
        lookups.with_tier(df, tiers).collect()
    kept = lookups.with_tier(df, tiers, unknown="keep").collect()
    assert sorted((r[0] or 0, r[1]) for r in kept) == [(0, None), (1, "AOD"), (9, None)]
    assert [tuple(r) for r in lookups.with_tier(df, tiers, unknown="drop").collect()] == [(1, "AOD")]
    with pytest.raises(ValueError):
        lookups.with_tier(df, tiers, unknown="other")


def test_mask_blanks_days_without_data_and_the_first_day(spark):
    series = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("union", 1, 7)], "source string, day int, n int"
    )
    valid = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "source string, day int")
    got = lookups.restrict_to_days(
        series, valid, ["n"], ["source"], first_day=1, always=F.col("source") == "union"
    ).collect()
    assert sorted((r.source, r.day, r.n) for r in got) == [
        ("a", 1, None), ("a", 2, None), ("a", 3, 30), ("union", 1, 7),
    ]


def test_group_sizes_count_records_and_distinct_items(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), (None, 3)], "k string, item int")
    got = daily.group_sizes(df, ["k"], "item").collect()
    assert sorted((r.k or "", r.nblocks, r.njobs) for r in got) == [("", 1, 1), ("a", 2, 4)]


def test_unknown_tier_fails_whatever_is_asked_for(spark):
    df = spark.createDataFrame([(1,), (9,)], "d_data_tier_id int")
    tiers = spark.createDataFrame([(1, "AOD")], "id int, data_tier string")
    for action in (lambda d: d.count(), lambda d: d.select("d_data_tier_id").collect(), lambda d: d.collect()):
        with pytest.raises(Exception, match="unknown data tier id: 9"):
            action(lookups.with_tier(df, tiers))
    assert lookups.with_tier(df.where("d_data_tier_id = 1"), tiers).count() == 1


def test_spread_join_on_numbers_and_nulls(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (7, 2), (8, 3)], "k long, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (8, "h"), (9, "c")], "r long, name string")
    hot = spark.createDataFrame([(1,), (7,)], "h long")
    joined = skew.spread_join(left, right, "k", "r", hot)
    assert joined.dtypes == [("k", "bigint"), ("v", "int"), ("name", "string")]
    assert sorted(map(tuple, joined.collect())) == sorted([(1, i, "a") for i in range(50)] + [(2, 0, "b"), (8, 3, "h")])


def test_kept_tables_follow_their_inputs(spark, tmp_path):
    source, kept = f"{tmp_path}/source", f"{tmp_path}/kept"
    spark.range(3).write.parquet(source)
    assert sinks.build_once(spark.read.parquet(source), kept).count() == 3
    spark.range(5).write.mode("append").parquet(source)
    assert sinks.build_once(spark.read.parquet(source), kept).count() == 8
    assert sinks.bucketed_once(spark.read.parquet(source), "kept_ids", "id", 2).count() == 8
    spark.range(2).write.mode("append").parquet(source)
    assert sinks.bucketed_once(spark.read.parquet(source), "kept_ids", "id", 2).count() == 10
    before = [f for f in (tmp_path / "kept").iterdir() if f.suffix == ".parquet"]
    sinks.build_once(spark.read.parquet(source), kept)
    after = [f for f in (tmp_path / "kept").iterdir() if f.suffix == ".parquet"]
    sinks.build_once(spark.read.parquet(source), kept)
    assert before != after and after == [f for f in (tmp_path / "kept").iterdir() if f.suffix == ".parquet"]
    spark.sql("drop table kept_ids")
