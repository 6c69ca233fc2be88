from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_campaign(spark):
    rows = [
        "/JetHT/Run2016F-23Sep2016-v1/AOD",
        "/X/HIRun2018A-PromptReco-v1/AOD",
        "/RelValTTbar/CMSSW_10_6_0-106X_mc-v1/GEN-SIM",
        "/TT/RunIISummer16DR80-PU_v1/MINIAODSIM",
        "/X/Run2020A-x-v1/AOD",
        "bad",
        None,
    ]
    assert values(spark, rows, fn.campaign("x")) == [
        "Run2016F-23Sep2016",
        "HIRun2018A-PromptReco",
        "CMSSW_10",
        "RunIISummer16DR80",
        "Run2020A",
        "",
        None,
    ]


def test_region_table_has_the_expected_sizes(spark):
    table = fn.region_labels()
    counts = {r: list(table.values()).count(r) for r in set(table.values())}
    assert counts == {"eu": 46, "us": 7, "other": 197}
    some = {"uk": "eu", "su": "other", "com": "other", "org": "us", "ca": "us", "eu": "eu", "ch": "eu", "jp": "other", "zw": "other"}
    assert {label: table[label] for label in some} == some
    assert not {"gb", "gg", "mm", "zz", "info"} & table.keys()


def test_host_region(spark):
    hosts = ["lab.ch", "ch", "1.2.3.4", "localhost", "LAB.US", "", None, "a.b.jp", "x.gb"]
    assert values(spark, hosts, fn.host_region("x")) == [
        "eu", "eu", None, None, None, None, None, "other", None,
    ]


def test_own_labels_with_quotes(spark):
    own = {"o'x": "it's", "b\\": "back"}
    assert values(spark, ["a.o'x", "b\\", "ch"], fn.host_region("x", own)) == ["it's", "back", None]


def test_node_country_and_region(spark):
    nodes = ["T1_US_SITE_Buffer", "T2_CH_SITE", "X", None]
    assert values(spark, nodes, fn.node_country("x")) == ["us", "ch", "x", None]
    assert values(spark, nodes, fn.node_region("x")) == ["us", "eu", None, None]


def test_bracketed_hosts_and_flags(spark):
    assert values(spark, ["[::1]", "lab.ch", None], fn.drop_bracketed("x")) == [None, "lab.ch", None]
    assert values(spark, ["a:crab:b", "z", None], fn.contains_flag("x")) == [True, False, None]


def test_tier_match_is_anchored_at_the_start(spark):
    tiers = ["AOD", "MINIAODSIM", "NANOAOD", "RAW", "XAOD", "USER", None]
    assert values(spark, tiers, fn.tier_matches("x")) == [True, True, True, False, False, False, None]


def test_day_start_and_number(spark):
    assert values(spark, [1550000000.5, -1.0, None], fn.day_start("x"), "double") == [1549929600, 0, None]
    assert values(spark, [1550000000, -1, None], fn.day_number("x"), "bigint") == [17939, -1, None]
    assert values(spark, [17939, None], fn.day_date("x"), "int") == [datetime.date(2019, 2, 12), None]


def test_time_texts(spark):
    seconds = fn.millis_to_seconds("x")
    rows = [1550000000999, None]
    assert values(spark, rows, fn.datetime_text(seconds), "bigint") == ["2019-02-12 19:33:20", None]
    assert values(spark, rows, fn.date_text(seconds), "bigint") == ["2019-02-12", None]
    assert values(spark, rows, fn.month_text(fn.date_text(seconds)), "bigint") == ["2019-02", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_ntz_seconds_does_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:15.9' as t")
        assert df.select(fn.ntz_seconds("t")).first()[0] == 1710037815
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_labels(spark):
    df = spark.createDataFrame([("us", "eu", True), ("us", "eu", False)], "c string, s string, a boolean")
    rows = df.select(fn.route_label("c", "s"), fn.necessity_label("a", "c", "s")).collect()
    assert [tuple(r) for r in rows] == [
        ("from us to eu", "block available in us = unnecessary us-eu transfer"),
        ("from us to eu", "block not available in us = necessary us-eu transfer"),
    ]
    null = F.lit(None).cast("string")
    assert df.select(fn.route_label("c", null)).first()[0] is None
