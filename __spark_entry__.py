"""

The tables stand in for access logs and catalogues (see ``FIXTURES.md`` section 5): ``lineitem`` and
``events`` are access logs, ``part`` is the block catalogue, ``orders`` the file catalogue, and
``customer`` and ``supplier`` are clients and servers. Sets are rendered as text
here only so that the results of both engines compare by value. Rolling results are checked
against the plain definition: every access is spread over the days it covers.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import bitmaps, counts, daily, lookups, rolling, sets, skew, stay_state, summaries, transfers
from tidemark.plans import daily_jobs, rolling_jobs, sampling, transfer_jobs
from tidemark.sources import adapters, published, readers, schemas, sinks

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and its SQL; ``ints`` are columns that are int in Spark and bigint there."""

    def register(build: Query) -> Query:
        _QUERIES[name] = build
        if sql is not None:
            casts = ", ".join(f"{c}::int as {c}" for c in ints)
            _ORACLES[name] = f"select * replace ({casts}) from ({sql})" if ints else sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local master may do without such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """The table after a trip through parquet, as one job hands it to the next."""
    path = _shared_path(spark, name)
    sinks.write_table(df, path)
    return readers.read_daily(spark, path)


def _text(array: str | Column) -> Column:
    return F.array_join(array, ",")


def _day(c: str) -> Column:
    return F.unix_date(F.to_date(c))


def _pick(choices: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (key % len(choices) + 1).cast("int"))


_SET = "array_to_string(list_sort(list(distinct {0}) filter (where {0} is not null)), ',')"


# --- the tables in their roles ----------------------------------------------

def _part_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as accesses of blocks: day number, block, site and return flag."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("block"),
        _day("l_shipdate").alias("day"),
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
    )


_PART_ACCESSES = """select l_partkey as block, l_shipdate::date - date '1970-01-01' as day,
    l_suppkey, l_returnflag, l_linestatus from lineitem"""


def _event_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("block"), _day("ts").alias("day")
    )


_EVENT_ACCESSES = """select event_type as source, user_id as block,
    ts::date - date '1970-01-01' as day from events"""


def _part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the blocks; those of one type are not in the catalogue."""
    return (
        _table(spark, sf_dir, "part")
        .where(F.col("p_type") != "PROMO")
        .select(
            F.col("p_partkey").alias("b_block_id"), F.col("p_size").cast("double").alias("b_block_size")
        )
    )


_PART_SIZES = "select p_partkey as block, p_size::bigint as size from part where p_type <> 'PROMO'"

_PATH_SQL = """case when p_size % 5 = 0 then p_name || p_partkey else
    '/' || p_name || p_partkey || '/' || case p_size % 4
        when 0 then 'Run201' || p_size % 10 || 'A-' || p_type || '-v1'
        when 1 then 'CMSSW_' || p_size || '_6_0-x'
        when 2 then 'Summer' || p_size || '-PU_v1'
        else 'plain' end || '/' || p_type end"""


def _path() -> Column:
    """A dataset path per part, in each form that the campaign pattern tells apart."""
    size, kind = F.col("p_size"), F.col("p_type")
    processed = (
        F.when(size % 4 == 0, F.concat(F.lit("Run201"), size % 10, F.lit("A-"), kind, F.lit("-v1")))
        .when(size % 4 == 1, F.concat(F.lit("CMSSW_"), size, F.lit("_6_0-x")))
        .when(size % 4 == 2, F.concat(F.lit("Summer"), size, F.lit("-PU_v1")))
        .otherwise("plain")
    )
    name = F.concat("p_name", "p_partkey")
    return F.when(size % 5 == 0, name).otherwise(
        F.concat(F.lit("/"), name, F.lit("/"), processed, F.lit("/"), kind)
    )


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("d_dataset_id"),
        _path().alias("d_dataset"),
        F.substring("p_brand", 7, 9).cast("bigint").alias("d_data_tier_id"),
    )


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.file_catalogue(_files(spark, sf_dir), _datasets(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/store/o/"), "o_orderkey").alias("f_logical_file_name"),
        F.col("o_custkey").alias("f_dataset_id"),
        F.floor(F.col("o_orderkey") / 4).alias("f_block_id"),
    )


_CATALOGUE = f"""datasets as (
    select p_partkey as dataset_id, {_PATH_SQL} as path, substr(p_brand, 7)::bigint as d_data_tier_id,
        regexp_extract(path, '^/[^/]*/((?:HI|PA|PN|XeXe|)Run201\\d\\w-[^-]+|CMSSW_\\d+|[^-]+)[^/]*/', 1)
            as input_campaign
    from part),
files as (
    select '/store/o/' || o_orderkey as lfn, o_custkey as dataset_id, o_orderkey // 4 as block_id
    from orders)"""


def _log(df: DataFrame, **fields: Column) -> DataFrame:
    """Log records: one ``data`` struct per row."""
    return df.select(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("data"))


def _ship_seconds() -> Column:
    return fn.ntz_seconds("l_shipdate")


_SHIP_SECONDS = "epoch_ms(l_shipdate) // 1000"


def _batch_job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").join(
        _table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return _log(
        lines,
        DESIRED_CMSDataset=F.when(F.col("l_linenumber") != 7, _path()),
        RecordTime=_ship_seconds() * 1000 + F.col("l_linenumber") * 7_200_500,
        Site=F.concat(F.lit("T"), F.col("l_suppkey") % 5, F.lit("_US_UC"), F.col("l_suppkey")),
        CMS_SubmissionTool=F.when(F.col("l_linestatus") == "O", "crab3").otherwise("other"),
        Status=F.when(F.col("l_returnflag") == "A", "Running").otherwise("Completed"),
    )


_BATCH_JOBS = f"""jobs as (
    select {_PATH_SQL} as dataset_name, 'T' || l_suppkey % 5 || '_US_UC' || l_suppkey as site_name,
        case when l_linestatus = 'O' then 'crab3' else 'other' end as "CMS_SubmissionTool",
        ({_SHIP_SECONDS} * 1000 + l_linenumber * 7200500) / 1000.0::double as "timestamp"
    from lineitem join part on l_partkey = p_partkey
    where l_linenumber <> 7 and l_returnflag <> 'A')"""


def _file_open_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(
        _table(spark, sf_dir, "lineitem"),
        file_lfn=F.concat(
            F.when(F.col("l_linenumber") == 7, "/user/o/").otherwise("/store/o/"), F.col("l_orderkey")
        ),
        end_time=_ship_seconds() + F.col("l_linenumber") * 20_000,
        app_info=F.when(F.col("l_returnflag") == "A", "a:crab:b").when(
            F.col("l_returnflag") == "N", "z"
        ),
        site_name=F.concat(F.lit("T2_S"), F.col("l_suppkey") % 9),
    )


_FILE_OPENS = f"""opens as (
    select '/store/o/' || l_orderkey as file_lfn, {_SHIP_SECONDS} + l_linenumber * 20000 as "timestamp",
        'T2_S' || l_suppkey % 9 as site_name,
        case l_returnflag when 'A' then true when 'N' then false end as is_crab
    from lineitem where l_linenumber <> 7)"""


def _remote_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(
        _table(spark, sf_dir, "lineitem"),
        file_lfn=F.concat(F.lit("/store/o/"), F.col("l_orderkey")),
        end_time=_ship_seconds() * 1000 + F.col("l_orderkey") % 86_400_000,
        client_domain=F.when(F.col("l_linenumber") == 3, "[::1]").when(
            F.col("l_linenumber") != 5, F.concat(F.lit("h"), F.col("l_suppkey") % 7, F.lit(".ch"))
        ),
        vo=F.when(F.col("l_linestatus") == "O", "cms").otherwise("x"),
    )


_REMOTE = f"""remote as (
    select '/store/o/' || l_orderkey as file_lfn,
        case when l_linenumber not in (3, 5) then 'h' || l_suppkey % 7 || '.ch' end as client_domain,
        ({_SHIP_SECONDS} * 1000 + l_orderkey % 86400000) / 1000.0::double as "timestamp"
    from lineitem where l_linestatus = 'O')"""


def _job_report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    site = F.struct(F.concat(F.lit("T1_S"), F.col("o_custkey") % 6).alias("site"))
    return _log(
        _table(spark, sf_dir, "orders"),
        meta_data=F.struct(
            F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("jobstate"),
            fn.ntz_seconds("o_orderdate").alias("ts"),
        ),
        steps=F.when(F.col("o_custkey") % 4 == 0, F.array().cast("array<struct<site:string>>")).otherwise(
            F.array(site, F.struct(F.lit("later").alias("site")))
        ),
        LFNArray=F.when(
            F.col("o_orderpriority") != "1-URGENT",
            F.array(
                F.concat(F.lit("/store/o/"), key),
                F.concat(F.lit("/store/o/"), key + 1),
                F.concat(F.lit("/store/unmerged/o/"), key),
                F.concat(F.lit("/x/"), key),
            ),
        ),
    )


_JOB_INPUTS = """inputs as (
    select case when o_custkey % 4 <> 0 then 'T1_S' || o_custkey % 6 end as site_name,
        '/store/o/' || (o_orderkey + step.n) as file_lfn, epoch_ms(o_orderdate) // 1000 as "timestamp"
    from orders, (values (0), (1)) as step(n)
    where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT')"""


def _region_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier per nation, AOD or RAW by region, and one more."""
    tiers = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.concat(F.when(F.col("n_regionkey") <= 2, "AOD").otherwise("RAW"), "n_name").alias("data_tier"),
    )
    return tiers.union(tiers.groupBy().agg(F.max("id") + 1, F.lit("NANOAOD")))


# --- projections, filters and source adapters --------------------------------

@_query(
    "nested_json_expand",
    "select event_id, json_extract(props, '$.k')::bigint as k from events",
)
def _nested_json_expand(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    props = F.from_json("props", schemas.table("k bigint"))
    return readers.flatten(events.select(F.struct("event_id", props.getField("k").alias("k")).alias("data")))


@_query("completed_access_filter", f"with {_BATCH_JOBS} select * from jobs")
def _completed_access_filter(spark, sf_dir):
    return adapters.batch_jobs(readers.flatten(_batch_job_log(spark, sf_dir)))


@_query("prefix_and_flag", f"with {_FILE_OPENS} select * from opens")
def _prefix_and_flag(spark, sf_dir):
    return adapters.file_opens(readers.flatten(_file_open_log(spark, sf_dir)))


@_query("suffix_nullout", f"with {_REMOTE} select * from remote")
def _suffix_nullout(spark, sf_dir):
    return adapters.remote_accesses(readers.flatten(_remote_log(spark, sf_dir)))


@_query("explode_items", f"with {_JOB_INPUTS} select * from inputs")
def _explode_items(spark, sf_dir):
    return adapters.job_inputs(readers.flatten(_job_report_log(spark, sf_dir)))


@_query(
    "first_item",
    """select '/store/' || p_partkey as file_lfn, case when p_size % 3 > 0 then string_split(p_name, ' ')[1] end as site_name
    from part""",
)
def _first_item(spark, sf_dir):
    """The site of a job's first step, NULL for a job without steps."""
    part, words = _table(spark, sf_dir, "part"), F.split("p_name", " ")
    steps = F.transform(F.when(F.col("p_size") % 3 > 0, words).otherwise(F.array().cast("array<string>")), lambda w: F.struct(w.alias("site")))
    log = part.select(
        F.struct(F.lit("success").alias("jobstate"), F.lit(1).alias("ts")).alias("meta_data"), steps.alias("steps"),
        F.array(F.concat(F.lit("/store/"), "p_partkey")).alias("LFNArray"),
    )
    return adapters.job_inputs(log).select("file_lfn", "site_name")


@_query(
    "campaign_extract",
    f"with {_CATALOGUE} select dataset_id, path, input_campaign from datasets",
)
def _campaign_extract(spark, sf_dir):
    return _datasets(spark, sf_dir).select(
        F.col("d_dataset_id").alias("dataset_id"),
        F.col("d_dataset").alias("path"),
        fn.campaign("d_dataset").alias("input_campaign"),
    )


@_query(
    "tier_match",
    """select p_partkey, tier, regexp_matches(tier, '^(|MINI|NANO)AOD') as is_aod from (
        select p_partkey, case p_size % 6 when 0 then 'AOD' when 1 then 'MINIAODSIM' when 2 then 'NANOAOD'
            when 3 then 'RAW' when 4 then 'XAOD' end || p_brand as tier from part)""",
)
def _tier_match(spark, sf_dir):
    size = F.col("p_size")
    tier = F.when(size % 6 == 0, "AOD").when(size % 6 == 1, "MINIAODSIM").when(size % 6 == 2, "NANOAOD")
    tier = F.concat(tier.when(size % 6 == 3, "RAW").when(size % 6 == 4, "XAOD"), "p_brand")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", tier.alias("tier"), fn.tier_matches(tier).alias("is_aod")
    )


@_query(
    "day_bucket",
    """select event_id, sec, ms / 1000.0::double as sec_double, sec - sec % 86400 as day_start, sec // 86400 as day_number
    from (select event_id, epoch_ms(date_trunc('second', ts)) // 1000 as sec,
        epoch_ms(date_trunc('second', ts)) + event_id % 1000 as ms from events)""",
)
def _day_bucket(spark, sf_dir):
    sec = fn.ntz_seconds("ts")
    millis = sec * 1000 + F.col("event_id") % 1000
    rows = _table(spark, sf_dir, "events").select(
        "event_id", sec.alias("sec"), fn.millis_to_seconds(millis).alias("sec_double")
    )
    start = fn.day_start("sec_double")
    return rows.withColumns({"day_start": start, "day_number": fn.day_number(start).cast("bigint")})


@_query(
    "day_labels",
    """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as datetime_text, strftime(ts, '%Y-%m-%d') as date_text,
        strftime(ts, '%Y-%m') as month_text, ts::date as day_date from events""",
)
def _day_labels(spark, sf_dir):
    sec = fn.ntz_seconds("ts")
    seconds = fn.millis_to_seconds(sec * 1000 + 999)
    return _table(spark, sf_dir, "events").select(
        "event_id",
        fn.datetime_text(seconds).alias("datetime_text"),
        fn.date_text(seconds).alias("date_text"),
        fn.month_text(fn.date_text(seconds)).alias("month_text"),
        fn.day_date(fn.day_number(sec)).alias("day_date"),
    )


@_query(
    "host_region",
    """select page_id, host, last_label,
        case last_label when 'com' then 'other' when 'net' then 'us' when 'org' then 'us' when 'edu' then 'us'
            when 'de' then 'eu' when 'fr' then 'eu' when 'es' then 'eu' end as region
    from (select page_id, host, regexp_extract(host, '[^.]*$') as last_label
        from (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages)
        union all
        select doc_id, host, regexp_extract(host, '[^.]*$') from (
            select doc_id, case when source = 'src0' then upper(source || '.' || lang) else source || '.' || lang end as host
            from documents))""",
)
def _host_region(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    )
    host = F.concat_ws(".", "source", "lang")
    documents = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.when(F.col("source") == "src0", F.upper(host)).otherwise(host).alias("host"),
    )
    return pages.union(documents).select(
        "page_id", "host", fn.last_label("host").alias("last_label"), fn.host_region("host").alias("region")
    )


_NODE_COUNTRIES = ["CH", "US", "JP", "FR", "BR", "US", "ZZ", "DE"]
_HOST_LABELS = ["ch", "edu", "jp", "fr", "br", "gov", "zz", "com"]
_REGIONS_SQL = """regions(label, region) as (values ('ch', 'eu'), ('edu', 'us'), ('us', 'us'), ('gov', 'us'),
    ('jp', 'other'), ('fr', 'eu'), ('br', 'other'), ('com', 'other'), ('de', 'eu'))"""


def _node(nation: str, number: str) -> Column:
    return F.concat(F.lit("T2_"), _pick(_NODE_COUNTRIES, F.col(nation)), F.lit("_N"), number)


@_query(
    "node_region",
    f"""with {_REGIONS_SQL}, nodes as (
        select s_suppkey, case when s_suppkey % 10 = 0 then 'CH' else
            'T2_' || ({_NODE_COUNTRIES})[s_nationkey % 8 + 1] || '_N' || s_suppkey end as node_name,
            case when s_suppkey % 10 = 0 then 'ch' else lower(({_NODE_COUNTRIES})[s_nationkey % 8 + 1]) end as country
        from supplier)
    select s_suppkey, node_name, country, region from nodes left join regions on country = label""",
)
def _node_region(spark, sf_dir):
    node = F.when(F.col("s_suppkey") % 10 == 0, "CH").otherwise(_node("s_nationkey", "s_suppkey"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", node.alias("node_name")).select(
        "*",
        fn.node_country("node_name").alias("country"),
        fn.node_region("node_name").alias("region"),
    )


@_query(
    "label_and_scale",
    """select o_orderkey, 'from ' || o_orderstatus || ' to ' || o_orderpriority as route,
        case when o_custkey % 2 = 0
            then 'block available in ' || o_orderstatus || ' = unnecessary ' || o_orderstatus || '-' || o_orderpriority || ' transfer'
            else 'block not available in ' || o_orderstatus || ' = necessary ' || o_orderstatus || '-' || o_orderpriority || ' transfer'
        end as necessity, o_totalprice / 1e12 as price_tera from orders""",
)
def _label_and_scale(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.route_label("o_orderstatus", "o_orderpriority").alias("route"),
        fn.necessity_label(F.col("o_custkey") % 2 == 0, "o_orderstatus", "o_orderpriority").alias("necessity"),
        "o_totalprice",
    )
    return summaries.in_units(orders, {"price_tera": "o_totalprice"}, summaries.TERA).drop("o_totalprice")


# --- daily working sets -------------------------------------------------------

def _as_text(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn(array, _text(array))


@_query(
    "daily_items_by_tier",
    f"""with {_CATALOGUE}, {_BATCH_JOBS}
    select ("timestamp"::bigint // 86400) * 86400 as day, input_campaign, d_data_tier_id,
        {_SET.format('dataset_id')} as working_set
    from (select dataset_name, floor("timestamp") as "timestamp" from jobs) join datasets on dataset_name = path group by all""",
)
def _daily_items_by_tier(spark, sf_dir):
    log = readers.flatten(_batch_job_log(spark, sf_dir))
    made = daily_jobs.daily_working_set("classads", log, _datasets(spark, sf_dir), pieces=1)
    return _as_text(made.drop("piece"), "working_set")


def _daily_blocks_sql(cte: str, name: str, keys: str) -> str:
    return f"""with {_CATALOGUE}, {cte}
    select (floor("timestamp")::bigint // 86400) * 86400 as day, input_campaign, d_data_tier_id, {keys},
        {_SET.format('block_id')} as working_set_blocks
    from {name} join files on file_lfn = lfn join datasets using (dataset_id) group by all"""


def _daily_blocks(spark, sf_dir, source: str, log: DataFrame) -> DataFrame:
    return daily_jobs.daily_working_set(
        source, readers.flatten(log), _datasets(spark, sf_dir), _catalogue(spark, sf_dir), pieces=1
    ).drop("piece")


@_query("daily_items_by_keys", _daily_blocks_sql(_FILE_OPENS, "opens", "site_name, is_crab"))
def _daily_items_by_keys(spark, sf_dir):
    daily_sets = _daily_blocks(spark, sf_dir, "cmssw", _file_open_log(spark, sf_dir))
    return _as_text(daily_sets, "working_set_blocks")


@_query("daily_items_by_client", _daily_blocks_sql(_REMOTE, "remote", "client_domain"))
def _daily_items_by_client(spark, sf_dir):
    daily_sets = _daily_blocks(spark, sf_dir, "xrootd", _remote_log(spark, sf_dir))
    return _as_text(daily_sets, "working_set_blocks")


@_query("daily_items_by_site", _daily_blocks_sql(_JOB_INPUTS, "inputs", "site_name"))
def _daily_items_by_site(spark, sf_dir):
    daily_sets = _daily_blocks(spark, sf_dir, "fwjr", _job_report_log(spark, sf_dir))
    return _as_text(daily_sets, "working_set_blocks")


@_query(
    "daily_members",
    f"""with {_CATALOGUE}, {_FILE_OPENS}
    select distinct ("timestamp" // 86400) * 86400 as day, input_campaign, d_data_tier_id, site_name, is_crab,
        block_id as f_block_id
    from opens join files on file_lfn = lfn join datasets using (dataset_id)""",
)
def _daily_members(spark, sf_dir):
    return daily_jobs.daily_members(
        "cmssw",
        readers.flatten(_file_open_log(spark, sf_dir)),
        _datasets(spark, sf_dir),
        _catalogue(spark, sf_dir),
    )


@_query(
    "daily_members_by_tool",
    f"""with {_CATALOGUE}, {_BATCH_JOBS}
    select distinct (floor("timestamp")::bigint // 86400) * 86400 as day, input_campaign, d_data_tier_id,
        "CMS_SubmissionTool", site_name, dataset_id as d_dataset_id
    from jobs join datasets on dataset_name = path""",
)
def _daily_members_by_tool(spark, sf_dir):
    return daily_jobs.daily_members(
        "classads",
        readers.flatten(_batch_job_log(spark, sf_dir)),
        _datasets(spark, sf_dir),
        keys=["CMS_SubmissionTool", "site_name"],
    )


@_query(
    "null_groups",
    f"""select case when l_returnflag <> 'N' then l_returnflag end as flag, l_linestatus,
        coalesce({_SET.format("case when l_linestatus = 'O' then l_suppkey end")}, '') as items
    from lineitem group by all""",
)
def _null_groups(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    members = daily.items_by_keys(
        lines,
        {"flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "l_linestatus": "l_linestatus"},
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")),
    )
    return _as_text(sets.to_arrays(members, ["flag", "l_linestatus"], "item", "items", 1).drop("piece"), "items")


@_query(
    "split_sets",
    """select l_returnflag, l_partkey from lineitem group by all""",
)
def _split_sets(spark, sf_dir):
    """Sets dealt to a fixed number of rows and put together again."""
    members = daily.items_by_keys(
        _table(spark, sf_dir, "lineitem"), {"l_returnflag": "l_returnflag"}, "l_partkey"
    )
    arrays = sets.to_arrays(members, ["l_returnflag"], "item", "items", pieces=5)
    return sets.to_members(arrays, ["l_returnflag"], "items", "l_partkey")


# --- set algebra ----------------------------------------------------------------

@_query(
    "item_map",
    "select distinct o_custkey, o_orderkey from orders",
)
def _item_map(spark, sf_dir):
    """The parts of each whole in pieces of bounded size, opened again."""
    made = sets.item_map(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "items")
    return sets.to_members(made, ["o_custkey"], "items", "o_orderkey")


def _order_bitmaps(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """The orders shipped per year and return flag, as bitmaps."""
    lines = _table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_returnflag", "l_orderkey")
    return bitmaps.to_bitmaps(lines, keys, "l_orderkey")


@_query("bitmap_sizes", "select year(l_shipdate) as year, l_returnflag, count(distinct l_orderkey) as n_items from lineitem group by all")
def _bitmap_sizes(spark, sf_dir):
    keys = ["year", "l_returnflag"]
    return bitmaps.sizes(_order_bitmaps(spark, sf_dir, keys), keys)


@_query("bitmap_union_sizes", "select year(l_shipdate) as year, count(distinct l_orderkey) as n_items from lineitem group by all")
def _bitmap_union_sizes(spark, sf_dir):
    """The size of the union of a year's sets, from their bitmaps."""
    return bitmaps.union_sizes(_order_bitmaps(spark, sf_dir, ["year", "l_returnflag"]), ["year"])


@_query(
    "bitmap_common",
    """select year(l_shipdate) as year, l_orderkey from lineitem group by all
    having count(distinct l_returnflag) = 2""",
)
def _bitmap_common(spark, sf_dir):
    """Orders of which lines with two of the return flags were shipped in a year, from pairs of bitmaps."""
    made, year = _order_bitmaps(spark, sf_dir, ["year", "l_returnflag"]), F.col("year")
    pairs = made.select(
        year, "bucket", "bits", F.explode(F.expr("filter(array('A N', 'A R', 'N R'), p -> contains(p, l_returnflag))")).alias("pair")
    )
    common = bitmaps.to_members(bitmaps.intersection(pairs, ["year", "pair"], 2), ["year", "pair"], "l_orderkey")
    # An order with all three is in three pairs.
    return common.groupBy("year", "l_orderkey").agg(F.count("pair").alias("n")).where("n = 1").drop("n")


@_query(
    "set_algebra_on_bitmaps",
    """with seen as (select distinct user_id as item, event_type from events)
    select event_type, item from seen union select 'all', item from seen""",
)
def _set_algebra_on_bitmaps(spark, sf_dir):
    """Sets of users per event type and their union, built, united and opened as bitmaps."""
    made = bitmaps.to_bitmaps(_table(spark, sf_dir, "events"), ["event_type"], "user_id")
    everyone = bitmaps.union(made.drop("event_type"), []).withColumn("event_type", F.lit("all"))
    return bitmaps.to_members(made.unionByName(everyone), ["event_type"], "item")


@_query(
    "expand_sets",
    f"""with days as (select ts::date - date '1970-01-01' as day, event_type, user_id from events)
    select day, event_type, coalesce({_SET.format('o_orderkey')}, '') as blocks
    from days left join orders on o_custkey = user_id * 7 group by all""",
)
def _expand_sets(spark, sf_dir):
    members = daily.items_by_keys(
        _table(spark, sf_dir, "events"),
        {"day": _day("ts").cast("bigint"), "event_type": "event_type"},
        F.col("user_id") * 7,
    )
    orders = _table(spark, sf_dir, "orders")
    expanded = sets.expand_members(members, "item", orders, "o_custkey", "o_orderkey")
    return _as_text(sets.to_arrays(expanded, ["day", "event_type"], "o_orderkey", "blocks", 1).drop("piece"), "blocks")


def _daily_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of parts per ship day and return flag."""
    members = daily.items_by_keys(
        _table(spark, sf_dir, "lineitem"),
        {"day": _day("l_shipdate"), "l_returnflag": "l_returnflag"},
        "l_partkey",
    )
    return sets.to_arrays(members, ["day", "l_returnflag"], "item", "items")


@_query(
    "daily_union",
    """select l_shipdate::date - date '1970-01-01' as day, count(distinct l_partkey) as n_items,
        sum(distinct l_partkey)::bigint as item_sum from lineitem group by all""",
    ints=("day",),
)
def _daily_union(spark, sf_dir):
    members = sets.daily_union(_daily_arrays(spark, sf_dir), ["day"], "items", "item")
    return members.groupBy("day").agg(
        F.count("item").alias("n_items"), F.sum("item").alias("item_sum")
    )


def _two_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets per order: the digits of its own and of its customer's number."""
    digits = lambda c: sets.as_set(
        F.regexp_extract_all(F.col(c).cast("string"), F.lit("[0-9]"), F.lit(0))
    )
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", digits("o_orderkey").alias("a"), digits("o_custkey").alias("b")
    )


def _two_sets_sql(result: str) -> str:
    return f"""with sides as (
        select o_orderkey, list_distinct(regexp_extract_all(o_orderkey::varchar, '[0-9]')) as a,
            list_distinct(regexp_extract_all(o_custkey::varchar, '[0-9]')) as b
        from orders)
    select o_orderkey, array_to_string(list_sort({result}), ',') as items,
        len({result}) as n_items from sides"""


def _set_query(combine: Callable) -> Query:
    def build(spark, sf_dir):
        result = combine("a", "b")
        return _two_sets(spark, sf_dir).select(
            "o_orderkey", _text(result).alias("items"), F.size(result).cast("bigint").alias("n_items")
        )

    return build


_query("set_union", _two_sets_sql("list_distinct(list_concat(a, b))"))(_set_query(sets.set_union))
_query("set_difference", _two_sets_sql("list_filter(a, lambda x: not list_contains(b, x))"))(
    _set_query(sets.set_difference)
)
_query("set_intersection", _two_sets_sql("list_filter(a, lambda x: list_contains(b, x))"))(
    _set_query(sets.set_intersection)
)


@_query(
    "as_set",
    """select p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '))), ',')
        as words from part""",
)
def _as_set(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", _text(sets.as_set(words)).alias("words"))


def _side(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.select("l_suppkey", "l_partkey")


for _name, _operator, _word in (
    ("union_rows", sets.union_rows, "union"),
    ("difference_rows", sets.difference_rows, "except"),
    ("intersection_rows", sets.intersection_rows, "intersect"),
):
    _query(
        _name,
        f"""select l_suppkey, l_partkey from lineitem where l_returnflag = 'A'
        {_word} select l_suppkey, l_partkey from lineitem where l_returnflag = 'R'""",
    )(lambda spark, sf_dir, op=_operator: op(_side(spark, sf_dir, "A"), _side(spark, sf_dir, "R")))


@_query(
    "bag_union",
    """select ts::date - date '1970-01-01' as day, user_id as item, event_type as source, null::varchar as flag from events
    union all
    select l_shipdate::date - date '1970-01-01', l_partkey, null, l_returnflag from lineitem""",
)
def _bag_union(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(
        _day("ts").cast("bigint").alias("day"),
        F.col("user_id").alias("item"),
        F.col("event_type").alias("source"),
    )
    lines = _table(spark, sf_dir, "lineitem").select(
        _day("l_shipdate").cast("bigint").alias("day"),
        F.col("l_partkey").alias("item"),
        F.col("l_returnflag").alias("flag"),
    )
    return sets.bag_union(events, lines)


# --- lookups ---------------------------------------------------------------------

@_query(
    "missing_sizes",
    f"select distinct l_partkey as block from lineitem where l_partkey not in (select block from ({_PART_SIZES}))",
)
def _missing_sizes(spark, sf_dir):
    return lookups.missing_items(
        _part_accesses(spark, sf_dir), "block", _part_sizes(spark, sf_dir), "b_block_id"
    )


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier names by brand number, from the nations: brands 1 to 24 have one, brand 25 has none."""
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("data_tier")
    )


@_query(
    "tier_lookup",
    """select p_partkey, substr(p_brand, 7)::bigint as tier_id, n_name as data_tier
    from part join nation on n_nationkey = substr(p_brand, 7)::bigint % 25""",
)
def _tier_lookup(spark, sf_dir):
    number = F.substring("p_brand", 7, 9).cast("bigint")
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey", number.alias("tier_id"), (number % 25).alias("key")
    )
    return lookups.with_tier(parts, _tiers(spark, sf_dir), "key").drop("key")


@_query(
    "tier_lookup_kept",
    """select p_partkey, substr(p_brand, 7)::bigint as tier_id, n_name as data_tier
    from part left join nation on n_nationkey = substr(p_brand, 7)::bigint""",
)
def _tier_lookup_kept(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 9).cast("bigint").alias("tier_id")
    )
    return lookups.with_tier(parts, _tiers(spark, sf_dir), "tier_id", unknown="keep")


@_query(
    "size_lookup",
    f"""select block, day, coalesce(size, 0)::bigint as item_size
    from (select distinct block, day from ({_PART_ACCESSES})) left join ({_PART_SIZES}) using (block)""",
)
def _size_lookup(spark, sf_dir):
    touched = _part_accesses(spark, sf_dir).select("block", F.col("day").cast("bigint").alias("day"))
    return lookups.with_size(
        touched.distinct(), "block", _part_sizes(spark, sf_dir), "b_block_id", "b_block_size"
    )


# --- rolling footprint -----------------------------------------------------------

@_query(
    "axis_limits",
    """select event_type as source, min(day) as lo, max(day) as hi
    from (select event_type, (select min(ts::date - date '1970-01-01') from events) as day from events
        union all select event_type, (select max(ts::date - date '1970-01-01') from events) from events) group by all""",
    ints=("lo", "hi"),
)
def _axis_limits(spark, sf_dir):
    accesses = _event_accesses(spark, sf_dir)
    lo, hi = rolling.data_axis(accesses)
    return accesses.select("source").distinct().select("source", lo.alias("lo"), hi.alias("hi"))


@_query(
    "dense_days",
    """with per_day as (select l_shipdate::date - date '1970-01-01' as day, count(*) as n_records
        from lineitem where l_returnflag = 'R' group by all),
    axis as (select min(day) as lo, max(day) as hi from per_day),
    spine as (select unnest(generate_series(lo, hi)) as day from axis)
    select day, coalesce(n_records, 0) as n_records from spine left join per_day using (day)""",
    ints=("day",),
)
def _dense_days(spark, sf_dir):
    accesses = _part_accesses(spark, sf_dir).where(F.col("l_returnflag") == "R")
    return rolling.fill_days(daily.records_per_day(accesses), ["n_records"])


def _rolling_sql(
    accesses: str,
    lookbacks: list[int],
    scope: str = "",
    axis: str = "select min(day) as lo, max(day) as hi from accesses",
    where: str = "true",
    result: str = "select * from series",
) -> str:
    """The definition: spread every access over the days it covers, then compare days."""
    s = f"{scope}, " if scope else ""
    same = f"and m.{scope} = p.{scope}" if scope else ""
    return f"""with accesses as ({accesses}), axis as ({axis}), sizes as ({_PART_SIZES}),
    lookbacks as (select unnest({lookbacks}) as lookback_days),
    chosen as (select distinct {s} block, day from accesses, axis where day between lo and hi and {where}),
    spine as (select {s} lookback_days, unnest(generate_series(lo, hi)) as day
        from {f'(select distinct {scope} from chosen),' if scope else ''} lookbacks, axis),
    held as (select distinct {s} lookback_days, block,
            unnest(generate_series(day, least(day + lookback_days, hi))) as day
        from chosen, lookbacks, axis),
    marked as (select m.*, coalesce(size, 0) as size, p.block is null as is_recall
        from held m left join sizes on sizes.block = m.block
        left join held p on p.block = m.block and p.lookback_days = m.lookback_days and p.day = m.day - 1 {same}),
    series as (select {s} lookback_days, day, count(block) as n_items, coalesce(sum(size), 0)::bigint as ws_size,
            count(block) filter (where is_recall) as n_recalls,
            coalesce(sum(size) filter (where is_recall), 0)::bigint as recall_size
        from spine left join marked using ({s} lookback_days, day) group by all)
    {result}"""


_ALL_LOOKBACKS = sorted(rolling.LOOKBACKS.values())


@_query("rolling_footprint", _rolling_sql(_PART_ACCESSES, _ALL_LOOKBACKS), ints=("day",))
def _rolling_footprint(spark, sf_dir):
    return rolling.rolling_footprint(
        _part_accesses(spark, sf_dir), "block", sizes=_part_sizes(spark, sf_dir)
    )


@_query("rolling_by_scope", _rolling_sql(_PART_ACCESSES, [7, 30], "l_returnflag"), ints=("day",))
def _rolling_by_scope(spark, sf_dir):
    return rolling.rolling_footprint(
        _part_accesses(spark, sf_dir),
        "block",
        scope=["l_returnflag"],
        sizes=_part_sizes(spark, sf_dir),
        lookbacks=[7, 30],
    )


@_query(
    "rolling_fixed_axis",
    _rolling_sql(_PART_ACCESSES, [7, 30], "l_returnflag", "select 10000 as lo, 11000 as hi"),
    ints=("day",),
)
def _rolling_fixed_axis(spark, sf_dir):
    """An axis that ends two days before a given time: accesses outside of it do not count."""
    return rolling.rolling_footprint(
        _part_accesses(spark, sf_dir),
        "block",
        scope=["l_returnflag"],
        sizes=_part_sizes(spark, sf_dir),
        lookbacks=[7, 30],
        axis=rolling.fixed_axis(now=11002 * 86400 + 5, first_day=10000),
    )


@_query(
    "recalls",
    """with accesses as (select distinct user_id as item, ts::date - date '1970-01-01' as day from events),
    axis as (select min(day) as lo, max(day) as hi from accesses),
    held as (select distinct item, unnest(generate_series(day, least(day + 0, hi))) as day from accesses, axis),
    recalled as (select item, day from held except select item, day + 1 from held)
    select 0 as lookback_days, day, count(item) as n_recalls
    from (select unnest(generate_series(lo, hi)) as day from axis) left join recalled using (day) group by all""",
    ints=("day",),
)
def _recalls(spark, sf_dir):
    series = rolling.rolling_footprint(_event_accesses(spark, sf_dir), "block", lookbacks=[0])
    return series.select("lookback_days", "day", "n_recalls")


@_query(
    "stays",
    f"""with accesses as (select distinct block, day from ({_PART_ACCESSES})),
    axis as (select max(day) as hi from accesses),
    held as (select distinct lookback_days, block, unnest(generate_series(day, least(day + lookback_days, hi))) as day
        from accesses, axis, (values (7), (30)) as l(lookback_days)),
    runs as (select *, day - row_number() over (partition by lookback_days, block order by day) as run from held)
    select lookback_days, block, min(day) as first_day, max(day) as last_day
    from runs group by lookback_days, block, run""",
    ints=("first_day", "last_day"),
)
def _stays(spark, sf_dir):
    return rolling.stays(_part_accesses(spark, sf_dir), "block", lookbacks=[7, 30])


@_query("rolling_extended", _rolling_sql(_PART_ACCESSES, [7, 30], "l_returnflag"), ints=("day",))
def _rolling_extended(spark, sf_dir):
    """The footprint in four runs, each of which gets the accesses of its own days and the state of the run before."""
    accesses, sizes = _part_accesses(spark, sf_dir), _part_sizes(spark, sf_dir)
    lo, hi = (int(x) for x in accesses.agg(F.min("day"), F.max("day")).first())
    types = {c: accesses.schema[c].dataType for c in ("block", "l_returnflag")}
    state = stay_state.empty_state(spark, "block", types["block"], {"l_returnflag": types["l_returnflag"]}, [7, 30], lo)
    parts = []
    for through in (lo + (hi - lo) // 3, lo + (hi - lo) // 2, hi - 1, hi):
        step = stay_state.extend(state, accesses.where(F.col("day") > state.through), through, sizes=sizes)
        state = stay_state.replace(step.state, open=_written(spark, "state", step.state.open))
        parts.append(step.series)
    return sets.bag_union(*parts)


@_query(
    "stays_extended",
    f"""with accesses as (select distinct block, day from ({_PART_ACCESSES})),
    axis as (select max(day) as hi from accesses),
    held as (select distinct lookback_days, block, unnest(generate_series(day, least(day + lookback_days, hi))) as day
        from accesses, axis, (values (7), (30)) as l(lookback_days)),
    runs as (select *, day - row_number() over (partition by lookback_days, block order by day) as run from held)
    select lookback_days, block, min(day) as first_day, max(day) as last_day
    from runs group by lookback_days, block, run""",
    ints=("first_day", "last_day"),
)
def _stays_extended(spark, sf_dir):
    """The stays that ended in each of two runs, and those still open after them."""
    accesses = _part_accesses(spark, sf_dir)
    lo, hi = (int(x) for x in accesses.agg(F.min("day"), F.max("day")).first())
    state, parts = stay_state.empty_state(spark, "block", accesses.schema["block"].dataType, {}, [7, 30], lo), []
    for through in ((lo + hi) // 2, hi):
        step = stay_state.extend(state, accesses.where(F.col("day") > state.through), through)
        state = stay_state.replace(step.state, open=_written(spark, "state", step.state.open))
        parts.append(step.ended)
    return sets.bag_union(*parts, stay_state.open_stays(state))


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part accesses with the layout of the slice jobs: tool, tier and site."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), "p_brand", "p_type")
    return _part_accesses(spark, sf_dir).join(parts, "block").select(
        "block",
        "day",
        F.when(F.col("l_linestatus") == "O", "crab3").otherwise("x").alias("SubmissionTool"),
        (F.col("l_returnflag") == "R").alias("crab_job"),
        F.concat(F.when(F.col("p_type") < "M", "MINIAOD").otherwise("AOD"), "p_brand").alias("data_tier"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 5, F.lit("_US_UC"), "l_suppkey").alias("SiteName"),
    )


_TIERED = f"""select block, day, case when l_linestatus = 'O' then 'crab3' else 'x' end as tool, l_returnflag = 'R' as crab_job,
    case when p_type < 'M' then 'MINIAOD' else 'AOD' end || p_brand as data_tier,
    'T' || l_suppkey % 5 || '_US_UC' || l_suppkey as site from ({_PART_ACCESSES}) join part on block = p_partkey"""


@_query(
    "site_slice_rolling",
    _rolling_sql(
        _TIERED,
        _ALL_LOOKBACKS,
        where="tool = 'crab3' and data_tier like '%MINIAOD%' and regexp_matches(site, '^T[23]_US_UC')",
        result="select *, ws_size / 1e15 as ws_size_pb, recall_size / 1e15 as recall_size_pb from series where day >= 9500",
    ),
    ints=("day",),
)
def _site_slice_rolling(spark, sf_dir):
    return rolling_jobs.grid_user_slice(
        _tiered(spark, sf_dir),
        _part_sizes(spark, sf_dir),
        axis=_part_accesses(spark, sf_dir).select("day"),
        show_from=9500,
    )


@_query(
    "tier_slice_rolling",
    _rolling_sql(
        _TIERED,
        [7, 30, 90],
        where="crab_job and data_tier like '%MINIAOD%'",
        result="select *, ws_size / 1e15 as ws_size_pb, recall_size / 1e15 as recall_size_pb from series",
    ),
    ints=("day",),
)
def _tier_slice_rolling(spark, sf_dir):
    days = _part_accesses(spark, sf_dir).select("day")
    return rolling_jobs.grid_job_slice(_tiered(spark, sf_dir), _part_sizes(spark, sf_dir), axis=days)


@_query(
    "slice_from_log",
    _rolling_sql(
        f"""with {_CATALOGUE}, {_BATCH_JOBS}
        select site_name as site, "CMS_SubmissionTool" as tool, data_tier, files.block_id as block,
            floor("timestamp")::bigint // 86400 as day
        from jobs join datasets on dataset_name = path left join files using (dataset_id)
        join (select n_nationkey as id, case when n_regionkey <= 2 then 'AOD' else 'RAW' end || n_name as data_tier from nation
            union all select 25, 'NANOAOD') on id = d_data_tier_id""",
        [7, 30],
        where="tool = 'crab3' and data_tier like '%AOD%' and regexp_matches(site, '^T[23]_US_UC') and block is not null",
        result="select *, ws_size / 1e15 as ws_size_pb, recall_size / 1e15 as recall_size_pb from series",
    ),
    ints=("day",),
)
def _slice_from_log(spark, sf_dir):
    """From the log through the daily table of datasets to the slice of their blocks."""
    members = daily_jobs.daily_members(
        "classads", readers.flatten(_batch_job_log(spark, sf_dir)), _datasets(spark, sf_dir), keys=["CMS_SubmissionTool", "site_name"]
    )
    blocks = _files(spark, sf_dir).select(F.col("f_dataset_id").alias("b_dataset_id"), F.col("f_block_id").alias("b_block_id"))
    table = rolling_jobs.DailyTable(_written(spark, "slice", members), "d_dataset_id", daily_jobs.dataset_blocks(blocks))
    return rolling_jobs.daily_slice(
        table,
        _region_tiers(spark, sf_dir),
        _part_sizes(spark, sf_dir),
        "AOD",
        {"CMS_SubmissionTool": "crab3"},
        {"site_name": "T[23]_US_UC"},
        lookbacks=[7, 30],
    )


@_query(
    "flag_slice_from_log",
    f"""select lookback_days, avg(recall_size) / 1e12 as mean_recall_tb from ({_rolling_sql(
        f"""with {_CATALOGUE}, {_FILE_OPENS}
        select "timestamp" // 86400 as day, is_crab, data_tier, files.block_id as block
        from opens join files on file_lfn = lfn join datasets using (dataset_id)
        join (select n_nationkey as id, case when n_regionkey <= 2 then 'AOD' else 'RAW' end || n_name as data_tier from nation
            union all select 25, 'NANOAOD') on id = d_data_tier_id""",
        [7, 30, 90],
        where="is_crab and data_tier like '%AOD%'",
        result="select * from series",
    )}) group by lookback_days""",
)
def _flag_slice_from_log(spark, sf_dir):
    """From the log of file opens through its daily table to the slice of one submission tool, by its flag, and its mean recall."""
    log = readers.flatten(_file_open_log(spark, sf_dir))
    members = daily_jobs.daily_members("cmssw", log, _datasets(spark, sf_dir), _catalogue(spark, sf_dir))
    table = rolling_jobs.DailyTable(_written(spark, "flags", members), "f_block_id")
    series = rolling_jobs.daily_slice(
        table, _region_tiers(spark, sf_dir), _part_sizes(spark, sf_dir), "AOD", flag_col="is_crab", lookbacks=[7, 30, 90]
    )
    return rolling_jobs.mean_recall(series)


@_query(
    "group_records",
    f"""with {_CATALOGUE}, {_FILE_OPENS}
    select "timestamp" - "timestamp" % 86400 as day, input_campaign, d_data_tier_id, is_crab,
        count(distinct files.block_id) as nblocks, count(*) as njobs
    from opens join files on file_lfn = lfn join datasets using (dataset_id) group by all""",
)
def _group_records(spark, sf_dir):
    return daily_jobs.group_records(
        "cmssw", readers.flatten(_file_open_log(spark, sf_dir)), _datasets(spark, sf_dir), _catalogue(spark, sf_dir), ["is_crab"]
    )


@_query(
    "large_sets",
    """select distinct year(l_shipdate) as year, l_returnflag, l_partkey from lineitem""",
)
def _large_sets(spark, sf_dir):
    """Sets of hundreds of members and more, kept as rows of bounded size and opened again."""
    keys = ["year", "l_returnflag"]
    lines = _table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_returnflag", "l_partkey")
    return bitmaps.to_members(_written(spark, "bitmaps", bitmaps.to_bitmaps(lines, keys, "l_partkey")), keys, "l_partkey")


@_query(
    "dated_logs_run",
    f"""with {_CATALOGUE}, {_FILE_OPENS}, {_REMOTE}
    select distinct 'cmssw' as source, "timestamp" - "timestamp" % 86400 as day, input_campaign, d_data_tier_id, site_name as place, block_id
    from opens join files on file_lfn = lfn join datasets using (dataset_id)
    union all
    select distinct 'xrootd', floor("timestamp")::bigint - floor("timestamp")::bigint % 86400, input_campaign, d_data_tier_id, client_domain, block_id
    from remote join files on file_lfn = lfn join datasets using (dataset_id)""",
)
def _dated_logs_run(spark, sf_dir):
    """The daily job on two sources whose logs lie in folders by year, asked for by a pattern of dates."""
    root = _shared_path(spark, "dated")
    for name, log, seconds in (
        ("cmssw", _file_open_log(spark, sf_dir), F.col("data.end_time")),
        ("xrootd", _remote_log(spark, sf_dir), F.floor(F.col("data.end_time") / 1000)),
    ):
        dated = log.withColumn("year", F.year(F.timestamp_seconds(seconds)))
        dated.write.partitionBy("year").option("compression", "gzip").json(f"{root}/{name}")
    for name, df, schema in (("files", _files(spark, sf_dir), schemas.FILES), ("datasets", _datasets(spark, sf_dir), schemas.DATASETS)):
        df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        ).write.option("nullValue", "null").csv(f"{root}/{name}")
    logs = {name: f"{root}/{name}/year={{dates}}/*.json.gz" for name in ("cmssw", "xrootd")}
    daily_jobs.run_daily(
        spark, logs, f"{root}/datasets", f"{root}/files", f"{root}/daily", dates="[12]*",
        catalogue_path=f"{root}/catalogue", keys={"cmssw": ["site_name"]},
    )
    tables = [
        readers.read_daily(spark, f"{root}/daily/working_set_{name}").select(
            F.lit(name).alias("source"), "day", "input_campaign", "d_data_tier_id", F.col(place).alias("place"), F.col("f_block_id").alias("block_id")
        )
        for name, place in (("cmssw", "site_name"), ("xrootd", "client_domain"))
    ]
    return tables[0].unionByName(tables[1])


def _as_csv(df: DataFrame, schema) -> DataFrame:
    """The columns of a catalogue, in its order; those that ``df`` lacks are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _half_year(date: Column) -> Column:
    """The first month of the half-year of a date."""
    return F.concat(F.year(date), F.when(F.month(date) <= 6, "-01").otherwise("-07"))


def _year_and_month(month: Column) -> list[Column]:
    return [F.substring(month, 1, 4).alias("year"), F.substring(month, 6, 2).alias("month")]


#: The four logs: how the time of a record reads, and the column that tells places apart in the daily table.
_LOGS = {
    "cmssw": (_file_open_log, "data.end_time", "site_name"),
    "xrootd": (_remote_log, "floor(data.end_time / 1000)", "client_domain"),
    "fwjr": (_job_report_log, "data.meta_data.ts", "site_name"),
    "classads": (_batch_job_log, "floor(data.RecordTime / 1000)", "d_data_tier_id"),
}


def _lay_out_months(spark: SparkSession, sf_dir: str, root: str) -> list[str]:
    """Logs and catalogues in files, the logs in folders of half a year that are named by its first month and a day: the first for the
    logs as they came, the second for corrections. The last half-year came with about half its records; it is there as a whole among
    the corrections. Returns the months."""
    for name, df, schema in (("files", _files(spark, sf_dir), schemas.FILES), ("datasets", _datasets(spark, sf_dir), schemas.DATASETS)):
        _as_csv(df, schema).write.option("nullValue", "null").csv(f"{root}/{name}")
    first, last = (
        _table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d"))
        .union(_table(spark, sf_dir, "lineitem").select("l_shipdate")).agg(F.min("d"), F.max("d")).first()
    )
    months = [f"{y}-{m}" for y in range(first.year, last.year + 2) for m in ("01", "07")]
    months = months[: months.index(f"{last.year}-{'01' if last.month <= 6 else '07'}") + 1]
    last = F.lit(f"{months[-1]}-01").cast("date")
    for name, (build, seconds, _) in _LOGS.items():
        # Records of the days after the last ship date lie in the last folder, too.
        date = F.to_date(F.timestamp_seconds(F.expr(seconds)))
        half_year = F.make_date(F.year(date), F.when(F.month(date) <= 6, 1).otherwise(7), F.lit(1))
        log = build(spark, sf_dir).withColumn("_month", F.least(half_year, last))
        corrected = F.date_add(last, 1)
        folders = F.when(F.col("_month") != last, F.array("_month")).when(F.xxhash64("data") % 2 == 0, F.array(last, corrected))
        # A date orders the rows of a task for the folders without comparing texts.
        laid_out = log.select("data", F.explode(folders.otherwise(F.array(corrected))).alias("folder"))
        laid_out.write.partitionBy("folder").option("zlib.compress.level", "BEST_SPEED").json(f"{root}/{name}", compression="gzip")
    return months


def _run_months(spark: SparkSession, root: str, folder: str, months: list[str]) -> dict[str, list[str]]:
    day = {"logs": "01", "corrected": "02"}[folder]
    logs = {name: f"{root}/{name}/folder={{year}}-{{month}}-{day}/*" for name in _LOGS}
    return daily_jobs.run_daily_months(
        spark, logs, months, f"{root}/datasets", f"{root}/files", f"{root}/daily", catalogue_path=f"{root}/catalogue"
    )


_DAILY_OF_SOURCES = f"""{_CATALOGUE}, {_FILE_OPENS}, {_REMOTE}, {_JOB_INPUTS}, {_BATCH_JOBS},
    daily as (
        select distinct 'cmssw' as source, "timestamp" // 86400 as day, input_campaign, d_data_tier_id, site_name as place, block_id as item
        from opens join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select distinct 'xrootd', floor("timestamp")::bigint // 86400, input_campaign, d_data_tier_id, client_domain, block_id
        from remote join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select distinct 'fwjr', "timestamp" // 86400, input_campaign, d_data_tier_id, site_name, block_id
        from inputs join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select distinct 'classads', floor("timestamp")::bigint // 86400, input_campaign, d_data_tier_id, d_data_tier_id::varchar, dataset_id
        from jobs join datasets on dataset_name = path)"""


@_query("daily_months_rerun", f"with {_DAILY_OF_SOURCES} select * from daily")
def _daily_months_rerun(spark, sf_dir):
    """All four sources over all months with one command, and one month run again after its logs were completed."""
    root = _shared_path(spark, "by_month")
    months = _lay_out_months(spark, sf_dir, root)
    _run_months(spark, root, "logs", ["1900-01", *months])
    _run_months(spark, root, "corrected", months[-1:])
    tables = []
    for name, (_, _, place) in _LOGS.items():
        table = daily_jobs.read_daily_table(spark, f"{root}/daily/working_set_{name}")
        item = daily_jobs.SOURCES[name].item
        tables.append(table.select(
            F.lit(name).alias("source"), F.expr("bigint(day) div 86400").alias("day"), "input_campaign", "d_data_tier_id",
            F.col(place).cast("string").alias("place"), F.col(item).alias("item"),
        ))
    # The table of file opens also tells submission tools apart.
    return sets.union_rows(*tables)


@_query(
    "footprint_update",
    f"""with {_DAILY_OF_SOURCES}, sizes as ({_PART_SIZES}),
    tiers as (select n_nationkey as id, case when n_regionkey <= 2 then 'AOD' else 'RAW' end || n_name as data_tier from nation
        union all select 25, 'NANOAOD'),
    every as (select source, day, d_data_tier_id, case when source = 'classads' then f.block_id else item end as block
        from daily left join files f on source = 'classads' and f.dataset_id = item),
    span as (select min(day) as lo, max(day) as hi from every),
    chosen as (
        select distinct unnest([source, 'union']) as source, day, block
        from every join tiers on id = d_data_tier_id
        where regexp_matches(data_tier, '^(|MINI|NANO)AOD') and block is not null),
    days as (select lookback_days, unnest(generate_series(lo, hi)) as day from span, (values (7), (30)) as l(lookback_days)),
    held as (select distinct source, lookback_days, block, unnest(generate_series(day, least(day + lookback_days, hi))) as day
        from chosen, span, (values (7), (30)) as l(lookback_days)),
    marked as (select m.*, coalesce(size, 0) as size, p.block is null as is_recall
        from held m left join sizes on sizes.block = m.block
        left join held p on p.block = m.block and p.source = m.source and p.day = m.day - 1 and p.lookback_days = m.lookback_days),
    spine as (select source, lookback_days, day from unnest(['cmssw', 'xrootd', 'fwjr', 'classads', 'union']) as s(source), days),
    series as (select source, lookback_days, day, count(block) as n_items, coalesce(sum(size), 0)::bigint as ws_size,
            count(block) filter (where is_recall) as n_recalls,
            coalesce(sum(size) filter (where is_recall), 0)::bigint as recall_size
        from spine left join marked using (source, lookback_days, day) group by all),
    shown as (select series.*, source = 'union' or (day > lo and exists (
        select 1 from every e where e.source = series.source and e.day = series.day)) as visible from series, span)
    select source, lookback_days, day, case when visible then n_items end as n_items,
        case when visible then ws_size end as ws_size, case when visible then n_recalls end as n_recalls,
        case when visible then recall_size end as recall_size,
        case when visible then ws_size / 1e15 end as ws_size_pb from shown""",
    ints=("day",),
)
def _footprint_update(spark, sf_dir):
    """The comparison carried on over daily tables by month: two runs, and one more from the first one's state after the last folder was corrected."""
    root = _shared_path(spark, "update")
    months = _lay_out_months(spark, sf_dir, root)
    _run_months(spark, root, "logs", months)
    blocks = _files(spark, sf_dir).select(F.col("f_dataset_id").alias("b_dataset_id"), F.col("f_block_id").alias("b_block_id"))

    def tables(days: tuple[int, int]) -> dict[str, rolling_jobs.DailyTable]:
        found = {name: daily_jobs.read_daily_table(spark, f"{root}/daily/working_set_{name}", days) for name in _LOGS}
        parts = {"classads": daily_jobs.dataset_blocks(blocks)}
        return {n: rolling_jobs.DailyTable(df, daily_jobs.SOURCES[n].item, parts.get(n)) for n, df in found.items()}

    known = [published.manifest(spark, f"{root}/daily/working_set_{name}").periods.values() for name in _LOGS]
    lo = min(p.first_day for found in known for p in found if p.n_rows) // 86400
    hi = max(p.last_day for found in known for p in found if p.n_rows) // 86400
    # The last day before the month that will be corrected.
    before = int(spark.sql(f"select unix_date(date '{months[-1]}-01') - 1").first()[0])

    def run(through: int, back_to: int | None = None) -> None:
        rolling_jobs.run_footprint(
            spark, tables, _region_tiers(spark, sf_dir), _part_sizes(spark, sf_dir), f"{root}/footprint", through, lo, [7, 30], back_to=back_to
        )

    for through in (before, hi):
        run(through)
    _run_months(spark, root, "corrected", months[-1:])
    run(hi, back_to=before)
    return rolling_jobs.read_footprint(spark, f"{root}/footprint")


@_query(
    "mean_recall",
    _rolling_sql(
        _PART_ACCESSES,
        [7, 30, 90],
        where="l_returnflag = 'R'",
        result="select lookback_days, avg(recall_size) / 1e12 as mean_recall_tb from series group by all",
    ),
)
def _mean_recall(spark, sf_dir):
    series = rolling_jobs.slice_rolling(
        _part_accesses(spark, sf_dir),
        [F.col("l_returnflag") == "R"],
        _part_sizes(spark, sf_dir),
        lookbacks=[7, 30, 90],
    )
    return rolling_jobs.mean_recall(series)


_COMPARED = f"""select source, block, day from ({_EVENT_ACCESSES})
    union all select 'lines', block, day from ({_PART_ACCESSES})"""


@_query(
    "source_comparison",
    _rolling_sql(
        f"select * from ({_COMPARED}) union all select 'union', block, day from ({_COMPARED})",
        [7],
        "source",
        result="""select source, lookback_days, day, case when visible then n_items end as n_items,
            case when visible then ws_size end as ws_size, case when visible then n_recalls end as n_recalls,
            case when visible then recall_size end as recall_size
        from (select series.*, source = 'union' or (day > lo and exists (
            select 1 from accesses a where a.source = series.source and a.day = series.day)) as visible from series, axis)""",
    ),
    ints=("day",),
)
def _source_comparison(spark, sf_dir):
    lines = _part_accesses(spark, sf_dir).select(F.lit("lines").alias("source"), "block", "day")
    accesses = sets.bag_union(_event_accesses(spark, sf_dir), lines)
    return rolling_jobs.source_comparison(accesses, _part_sizes(spark, sf_dir))


@_query(
    "source_comparison_wide",
    _rolling_sql(
        f"select * from ({_EVENT_ACCESSES}) union all select 'union', block, day from ({_EVENT_ACCESSES})",
        [7],
        "source",
        result="""select lookback_days, day,
            max(case when source = 'click' and day > lo then ws_size end) as click,
            max(case when source = 'purchase' and day > lo then ws_size end) as purchase,
            max(case when source = 'union' then ws_size end) as "union"
        from series, axis group by all""",
    ),
    ints=("day",),
)
def _source_comparison_wide(spark, sf_dir):
    series = rolling_jobs.source_comparison(
        _event_accesses(spark, sf_dir), _part_sizes(spark, sf_dir)
    )
    return rolling_jobs.pivot_sources(series, ["click", "purchase", "union"])


def _monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily table that comes ready-made, without campaign or site."""
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("block"), F.substring("p_brand", 7, 9).cast("bigint").alias("d_data_tier_id")
    )
    members = _part_accesses(spark, sf_dir).join(parts, "block").select(
        (F.col("day").cast("bigint") * 86400).alias("day"), "d_data_tier_id", "block"
    )
    return members.distinct()


@_query(
    "aod_comparison",
    f"""with {_CATALOGUE}, {_FILE_OPENS}, {_REMOTE}, {_JOB_INPUTS}, {_BATCH_JOBS}, sizes as ({_PART_SIZES}),
    tiers as (select n_nationkey as id, case when n_regionkey <= 2 then 'AOD' else 'RAW' end || n_name as data_tier from nation
        union all select 25, 'NANOAOD'),
    every as (
        select 'files' as source, "timestamp" // 86400 as day, d_data_tier_id, files.block_id as block
        from opens join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select 'remote', floor("timestamp")::bigint // 86400, d_data_tier_id, files.block_id
        from remote join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select 'inputs', "timestamp" // 86400, d_data_tier_id, files.block_id
        from inputs join files on file_lfn = lfn join datasets using (dataset_id)
        union all
        select 'monitoring', l_shipdate::date - date '1970-01-01', substr(p_brand, 7)::bigint, l_partkey
        from lineitem join part on l_partkey = p_partkey
        union all
        select 'jobs', floor("timestamp")::bigint // 86400, d_data_tier_id, files.block_id
        from jobs join datasets on dataset_name = path left join files using (dataset_id)),
    span as (select min(day) as lo, max(day) as hi from every),
    chosen as (
        select distinct unnest([source, 'union']) as source, day, block
        from every join tiers on id = d_data_tier_id
        where regexp_matches(data_tier, '^(|MINI|NANO)AOD') and block is not null),
    held as (select distinct source, block, unnest(generate_series(day, least(day + 7, hi))) as day from chosen, span),
    marked as (select m.*, coalesce(size, 0) as size, p.block is null as is_recall
        from held m left join sizes on sizes.block = m.block
        left join held p on p.block = m.block and p.source = m.source and p.day = m.day - 1),
    spine as (select source, day from unnest(['files', 'remote', 'inputs', 'monitoring', 'jobs', 'union']) as s(source),
        (select unnest(generate_series(lo, hi)) as day from span)),
    series as (select source, day, count(block) as n_items, coalesce(sum(size), 0)::bigint as ws_size,
            count(block) filter (where is_recall) as n_recalls,
            coalesce(sum(size) filter (where is_recall), 0)::bigint as recall_size
        from spine left join marked using (source, day) group by all),
    shown as (select series.*, source = 'union' or (day > lo and exists (
        select 1 from every e where e.source = series.source and e.day = series.day)) as visible from series, span)
    select source, 7 as lookback_days, day, case when visible then n_items end as n_items,
        case when visible then ws_size end as ws_size, case when visible then n_recalls end as n_recalls,
        case when visible then recall_size end as recall_size,
        case when visible then ws_size / 1e15 end as ws_size_pb from shown""",
    ints=("day",),
)
def _aod_comparison(spark, sf_dir):
    return rolling_jobs.aod_comparison(_aod_tables(spark, sf_dir), _region_tiers(spark, sf_dir), _part_sizes(spark, sf_dir))


def _aod_tables(spark: SparkSession, sf_dir: str) -> dict[str, rolling_jobs.DailyTable]:
    """Five daily tables, written as the daily job writes them."""
    datasets, files = _datasets(spark, sf_dir), _files(spark, sf_dir)
    blocks = files.select(
        F.col("f_dataset_id").alias("b_dataset_id"), F.col("f_block_id").alias("b_block_id")
    )
    catalogue = daily.file_catalogue(files, datasets)
    logs = {
        "files": ("cmssw", _file_open_log(spark, sf_dir)),
        "remote": ("xrootd", _remote_log(spark, sf_dir)),
        "inputs": ("fwjr", _job_report_log(spark, sf_dir)),
        "jobs": ("classads", _batch_job_log(spark, sf_dir)),
    }
    tables = {n: daily_jobs.daily_members(source, readers.flatten(log), datasets, catalogue) for n, (source, log) in logs.items()}
    tables["monitoring"] = _monitored(spark, sf_dir)
    members = {"monitoring": ("block",), "jobs": ("d_dataset_id", daily_jobs.dataset_blocks(blocks))}
    return {
        name: rolling_jobs.DailyTable(_written(spark, name, df), *members.get(name, ("f_block_id",))) for name, df in tables.items()
    }


# --- summaries ---------------------------------------------------------------------

@_query(
    "group_sizes",
    """select l_shipdate::date - date '1970-01-01' as day, l_returnflag, count(distinct l_partkey) as nblocks,
        count(*) as njobs from lineitem group by all""",
)
def _group_sizes(spark, sf_dir):
    return daily.group_sizes(
        _part_accesses(spark, sf_dir).select(F.col("day").cast("bigint").alias("day"), "l_returnflag", "block"),
        ["day", "l_returnflag"],
        "block",
    )


@_query(
    "size_histogram",
    """with groups as (select l_suppkey, count(distinct l_partkey)::double as nblocks, count(*)::double as njobs
        from lineitem group by all),
    long as (select 'nblocks' as measure, nblocks as x from groups union all select 'njobs', njobs from groups),
    limits as (select measure, min(x) as lo, (max(x) - min(x)) / 10 as step, max(x) as hi from long group by all),
    edges as (select measure, i as bin, lo + (i - 1) * step as bin_low, case when i = 10 then hi else lo + i * step end as bin_high
        from limits, generate_series(1, 10) as g(i))
    select e.measure, bin::int as bin, bin_low, bin_high, count(x) as n
    from edges e left join long l on l.measure = e.measure and x >= bin_low and (x < bin_high or (bin = 10 and x <= bin_high))
    group by all""",
)
def _size_histogram(spark, sf_dir):
    groups = daily.group_sizes(_part_accesses(spark, sf_dir), ["l_suppkey"], "block")
    return rolling_jobs.group_histograms(groups)


@_query(
    "top_rows",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem order by all limit 10",
)
def _top_rows(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return summaries.first_rows(lines, lines.columns)


@_query("row_count", "select count(*) as n_rows from lineitem")
def _row_count(spark, sf_dir):
    """Counted on the way of a job over the table, not by a pass of its own."""
    return spark.createDataFrame([(counts.n_rows(_table(spark, sf_dir, "lineitem")),)], "n_rows bigint")


@_query(
    "days_with_data",
    "select distinct event_type as source, ts::date - date '1970-01-01' as day from events",
    ints=("day",),
)
def _days_with_data(spark, sf_dir):
    return daily.days_with_data(_event_accesses(spark, sf_dir), by=["source"])


# --- transfers -----------------------------------------------------------------------

def _transfer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transfers from the supplier's nation to the customer's."""
    lines = (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    client, server = F.col("c_nationkey"), F.col("s_nationkey")
    return _log(
        lines,
        file_lfn=F.concat(F.lit("/store/p/"), F.col("l_partkey"), F.lit("/"), F.col("l_linenumber")),
        start_time=_ship_seconds() * 1000 + F.col("l_orderkey") % 24 * 3_600_000 + 999,
        client_domain=F.concat(F.lit("c"), client % 5, F.lit("."), _pick(_HOST_LABELS, client)),
        client_host=F.concat(F.lit("h"), F.col("l_orderkey") % 3),
        server_domain=F.concat(F.lit("s."), _pick(_HOST_LABELS, server)),
        operation=F.when(F.col("l_linestatus") == "O", "read").otherwise("write"),
        read_bytes=F.col("l_quantity").cast("bigint") * 1000,
        write_bytes=F.lit(0).cast("bigint"),
    )


def _transfer_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    lines, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    sizes = part.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    files = lines.select("l_partkey", "l_linenumber").distinct().join(sizes, "l_partkey").select(
        F.concat(F.lit("/store/p/"), "l_partkey", F.lit("/"), "l_linenumber").alias("f_logical_file_name"),
        F.floor(F.col("p_size") / 2).alias("f_dataset_id"),
        F.col("l_partkey").alias("f_block_id"),
    )
    datasets = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("d_dataset_id"))
    name = F.concat("p_name", F.lit("#"), "p_partkey")
    blocks = part.select(F.col("p_partkey").alias("b_block_id"), name.alias("b_block_name"))
    replicas = (
        lines.where(F.col("l_returnflag") == "R")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (_ship_seconds() + 3600).cast("double").alias("now_sec"),
            name.alias("block_name"),
            _node("s_nationkey", "s_suppkey").alias("node_name"),
        )
    )
    return readers.flatten(_transfer_log(spark, sf_dir)), files, datasets, blocks, replicas


def _transfers_sql(snapshots: str, judged_by: str, result: str = "select * from matrix") -> str:
    return f"""with {_REGIONS_SQL},
    replicas as (select l_shipdate::date as date, l_partkey as block, region
        from lineitem join supplier on l_suppkey = s_suppkey
        left join regions on label = lower(({_NODE_COUNTRIES})[s_nationkey % 8 + 1])
        where l_returnflag = 'R'),
    snapshots as (select * from replicas where {snapshots}),
    reads as (select distinct l_shipdate::date as date, l_orderkey % 24 as hour, l_partkey as block,
            c_nationkey % 5 as client_number, ({_HOST_LABELS})[c_nationkey % 8 + 1] as client_label, l_orderkey % 3 as client_host,
            ({_HOST_LABELS})[s_nationkey % 8 + 1] as server_label, l_quantity::bigint * 1000 as bytes
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
        where l_linestatus = 'O' and p_size // 2 in (select n_nationkey from nation)),
    dated as ({judged_by}),
    judged as (select date, bytes, s.region as server_location, c.region as client_location,
            exists (select 1 from snapshots r where r.date = snapshot_date and r.block = dated.block
                and r.region = c.region) as dataset_at_client_location
        from dated join regions c on client_label = c.label left join regions s on server_label = s.label
        where exists (select 1 from snapshots r where r.date = snapshot_date and r.block = dated.block)),
    matrix as (select strftime(date, '%Y-%m') as year_month, server_location, client_location,
            dataset_at_client_location, sum(bytes)::bigint as total_read_bytes from judged group by all)
    {result}"""


_OWN_DATE = "select *, date as snapshot_date from reads"
_CARRIED = """select reads.*, snapshot_date from reads join (
        select d.date, max(s.date) as snapshot_date
        from (select distinct date from reads) d join snapshots s on s.date <= d.date and s.date >= d.date - 30
        group by d.date) using (date)"""


@_query("transfer_matrix", _transfers_sql("true", _OWN_DATE))
def _transfer_matrix(spark, sf_dir):
    return transfer_jobs.monthly_transfers(*_transfer_inputs(spark, sf_dir), first_of_month=False)


@_query("transfer_matrix_spread", _transfers_sql("true", _OWN_DATE))
def _transfer_matrix_spread(spark, sf_dir):
    """The same matrix with the rows of popular files spread in the join with the catalogue."""
    inputs = _transfer_inputs(spark, sf_dir)
    reads = transfers.read_accesses(inputs[0]).groupBy("file_lfn").count()
    hot = reads.where("count >= 6").select("file_lfn")
    return transfer_jobs.monthly_transfers(*inputs, first_of_month=False, hot_files=hot)


_SKEWED_SQL = "case when l_linenumber <= 2 then l_suppkey % 5 * 2 - 3 else l_partkey end"


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem under a key of which a few values have a large part of the rows; part does not know the negative ones."""
    key = F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey") % 5 * 2 - 3).otherwise(F.col("l_partkey"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", key.alias("key"))


@_query(
    "frequent_keys",
    f"""select {_SKEWED_SQL} as key from lineitem group by all
    having count(*) >= 0.02 * (select count(*) from lineitem)""",
)
def _frequent_keys(spark, sf_dir):
    return skew.frequent_keys(_skewed(spark, sf_dir), "key", 0.02)


@_query(
    "sketched_keys",
    f"""select {_SKEWED_SQL} as key from lineitem group by all
    having count(*) >= 0.02 * (select count(*) from lineitem)""",
)
def _sketched_keys(spark, sf_dir):
    """The same keys from sketches of each ship year, merged."""
    lines = _skewed(spark, sf_dir).withColumn("year", F.year("l_shipdate"))
    sketches = lines.groupBy("year").agg(skew.sketch("key").alias("sketch"), F.count(F.lit(1)).alias("n_rows"))
    return skew.sketched_keys(_written(spark, "sketches", sketches), "key", 0.02)


@_query(
    "spread_join",
    f"""select l_orderkey, l_linenumber, l_quantity, {_SKEWED_SQL} as key, p_name, p_size
    from lineitem join part on {_SKEWED_SQL} = p_partkey""",
)
def _spread_join(spark, sf_dir):
    """A join on numbers, of which some are hot and have a partner, some are hot without, and most are not."""
    lines = _skewed(spark, sf_dir).drop("l_shipdate")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return skew.spread_join(lines, parts, "key", "p_partkey", skew.frequent_keys(lines, "key", 0.02))


#: The month that names the folder of a record: a folder holds half a year, and begins with the last day of the month before.
_FOLDER_MONTH = "(strftime({0}::date + 1, '%Y') || case when month({0}::date + 1) <= 6 then '-01' else '-07' end)"


@_query(
    "transfer_months_rerun",
    f"""with {_REGIONS_SQL},
    last as (select max({_FOLDER_MONTH.format("l_shipdate")}) as month from lineitem),
    replicas as (select {_FOLDER_MONTH.format("l_shipdate")} as month, l_shipdate::date as date, l_partkey as block, region
        from lineitem join supplier on l_suppkey = s_suppkey
        left join regions on label = lower(({_NODE_COUNTRIES})[s_nationkey % 8 + 1]) where l_returnflag = 'R' or l_linestatus = 'O'),
    reads as (select distinct {_FOLDER_MONTH.format("l_shipdate")} as month, l_shipdate::date as date, l_orderkey % 24 as hour, l_partkey as block,
            c_nationkey % 5 as client_number, ({_HOST_LABELS})[c_nationkey % 8 + 1] as client_label, l_orderkey % 3 as client_host,
            ({_HOST_LABELS})[s_nationkey % 8 + 1] as server_label,
            l_quantity::bigint * 1000 * (case when {_FOLDER_MONTH.format("l_shipdate")} = month then 10 else 1 end) as bytes
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey, last
        where l_linestatus = 'O' and p_size // 2 in (select n_nationkey from nation)),
    judged as (select month, bytes, s.region as server_location, c.region as client_location,
            exists (select 1 from replicas r where r.month = reads.month and r.date = reads.date and r.block = reads.block
                and r.region = c.region) as dataset_at_client_location
        from reads join regions c on client_label = c.label left join regions s on server_label = s.label
        where exists (select 1 from replicas r where r.month = reads.month and r.date = reads.date and r.block = reads.block))
    select month as year_month, server_location, client_location, dataset_at_client_location,
        sum(bytes)::bigint as total_read_bytes from judged group by all""",
)
def _transfer_months_rerun(spark, sf_dir):
    """The job on all folders, each of which begins with the last day of the month before; the last is then run again on other bytes."""
    root = _shared_path(spark, "months")
    log, files, datasets, blocks, _ = _transfer_inputs(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' or l_linestatus = 'O'")
    suppliers, part = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "part")
    replicas = lines.join(part, lines.l_partkey == part.p_partkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        (_ship_seconds() + 3600).cast("double").alias("now_sec"),
        F.concat("p_name", F.lit("#"), "p_partkey").alias("block_name"),
        _node("s_nationkey", "s_suppkey").alias("node_name"),
    )
    for name, df, schema in (("files", files, schemas.FILES), ("datasets", datasets, schemas.DATASETS), ("blocks", blocks, schemas.BLOCKS)):
        _as_csv(df, schema).write.option("nullValue", "null").csv(f"{root}/{name}", compression="gzip")

    def month_of(seconds: Column) -> Column:
        return _half_year(F.date_add(F.to_date(F.timestamp_seconds(seconds)), 1))

    log = log.withColumn("month", month_of(F.floor(F.col("start_time") / 1000)))
    def lay_out(version: str, log: DataFrame) -> None:
        records = log.select(F.struct(*[c for c in log.columns if c != "month"]).alias("data"), *_year_and_month(F.col("month")))
        records.write.partitionBy("year", "month").json(f"{root}/{version}/log", compression="gzip")

    lay_out("first", log)
    # The log is joined once: the folders tell the months, and the last one's records are read back.
    data = F.struct(*[c for c in log.columns if c != "month"])
    first = spark.read.schema(log.select(data.alias("data")).schema)
    folders = [re.search(r"year=(\d+)/month=(\d+)/", f) for f in first.json(f"{root}/first/log").inputFiles()]
    months = sorted({f"{f[1]}-{f[2]}" for f in folders if f})
    last = first.json("{0}/first/log/year={1}/month={2}".format(root, *months[-1].split("-"))).select("data.*", F.lit(months[-1]).alias("month"))
    lay_out("again", last.withColumn("read_bytes", F.col("read_bytes") * 10))
    snapshots = _as_csv(replicas, schemas.REPLICAS).withColumn("time", F.concat(month_of(F.col("now_sec")), F.lit("-01_03h07m10s")))
    snapshots.write.partitionBy("time").option("nullValue", "null").csv(f"{root}/replicas", compression="gzip")
    for version, wanted in (("first", ["1900-01", *months]), ("again", months[-1:])):
        transfer_jobs.run_transfers(
            spark,
            f"{root}/{version}/log/year={{year}}/month={{month}}/*",
            f"{root}/replicas/time={{year}}-{{month}}-01_??h??m??s/*",
            f"{root}/files",
            f"{root}/datasets",
            f"{root}/blocks",
            f"{root}/matrix",
            wanted,
        )
    return transfer_jobs.load_transfers(spark, f"{root}/matrix")


@_query("transfer_matrix_first_of_month", _transfers_sql("day(date) = 1", _OWN_DATE))
def _transfer_matrix_first_of_month(spark, sf_dir):
    return transfer_jobs.monthly_transfers(*_transfer_inputs(spark, sf_dir))


@_query("transfer_matrix_carried", _transfers_sql("day(date) = 1", _CARRIED))
def _transfer_matrix_carried(spark, sf_dir):
    return transfer_jobs.monthly_transfers(*_transfer_inputs(spark, sf_dir), carry_days=30)


@_query(
    "replica_locality",
    """select l_shipdate::date as snapshot_date, p_name || '#' || p_partkey as block_name,
        coalesce(array_to_string(list_sort(list(distinct region) filter (where region is not null)), ','), '') as regions
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    left join (values ('CH', 'eu'), ('US', 'us'), ('JP', 'other'), ('FR', 'eu'), ('BR', 'other'), ('DE', 'eu')) as r(label, region)
        on label = (['CH', 'US', 'JP', 'FR', 'BR', 'US', 'ZZ', 'DE'])[s_nationkey % 8 + 1]
    where l_returnflag = 'R' group by all""",
)
def _replica_locality(spark, sf_dir):
    replicas = _transfer_inputs(spark, sf_dir)[-1]
    regions = transfers.replica_regions(transfers.dated_replicas(replicas, first_of_month=False))
    return regions.withColumn("regions", _text(F.sort_array("regions")))


@_query(
    "monthly_overview",
    _transfers_sql(
        "true",
        _OWN_DATE,
        """select year_month, server_location, client_location, sum(total_read_bytes)::bigint as total_read_bytes,
            'from ' || client_location || ' to ' || server_location as route
        from matrix where server_location is not null group by all""",
    ),
)
def _monthly_overview(spark, sf_dir):
    return transfer_jobs.overview(_transfer_matrix(spark, sf_dir))


@_query(
    "cross_region_split",
    _transfers_sql(
        "true",
        _OWN_DATE,
        """select *, case when dataset_at_client_location
            then 'block available in ' || client_location || ' = unnecessary ' || client_location || '-' || server_location || ' transfer'
            else 'block not available in ' || client_location || ' = necessary ' || client_location || '-' || server_location || ' transfer'
            end as necessity
        from matrix where (client_location, server_location) in (('us', 'eu'), ('eu', 'us'))""",
    ),
)
def _cross_region_split(spark, sf_dir):
    matrix = _transfer_matrix(spark, sf_dir)
    return transfer_jobs.cross_region(matrix, "us", "eu").unionByName(
        transfer_jobs.cross_region(matrix, "eu", "us")
    )


# --- sources and sinks ------------------------------------------------------------------

@_query("json_log_scan", f"with {_FILE_OPENS} select * from opens")
def _json_log_scan(spark, sf_dir):
    path = _shared_path(spark, "log")
    _file_open_log(spark, sf_dir).write.option("compression", "gzip").json(path)
    log = readers.read_log(spark, f"{path}/*.json.gz", schemas.FILE_OPEN_REPORTS)
    return adapters.file_opens(log)


@_query(
    "broken_records",
    """select case when o_orderkey % 13 = 0 then '{"data": {"file_lfn": "/store/o/' || o_orderkey || '", "end_' end as record, count(*) as n
    from orders group by all""",
)
def _broken_records(spark, sf_dir):
    """A log of which some lines are cut off: their text, and (NULL) the number of whole records."""
    path, key = _shared_path(spark, "broken"), F.col("o_orderkey").cast("string")
    cut = F.concat(F.lit('{"data": {"file_lfn": "/store/o/'), key, F.lit('", "end_'))
    line = F.when(F.col("o_orderkey") % 13 == 0, cut).otherwise(F.concat(cut, F.lit('time": 5}}')))
    _table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    records = readers.read_records(spark, path, schemas.FILE_OPEN_REPORTS)
    bad = readers.quarantined(records).groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    whole = records.where(~readers.broken()).select("data.*").where("end_time = 5").agg(F.lit(None).cast("string").alias("record"), F.count("file_lfn").alias("n"))
    return bad.unionByName(whole)


@_query(
    "csv_catalogue_scan",
    "select p_partkey as block_id, case when p_size % 3 <> 0 then p_size::bigint end as block_size from part",
)
def _csv_catalogue_scan(spark, sf_dir):
    path = _shared_path(spark, "blocks")
    size = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    filled = {"b_block_id": F.col("p_partkey"), "b_block_name": F.col("p_name"), "b_block_size": size}
    _table(spark, sf_dir, "part").select(
        *[
            filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.BLOCKS.fields
        ]
    ).write.option("nullValue", "null").csv(path)
    blocks = readers.read_catalogue(spark, path, schemas.BLOCKS)
    ids = readers.select_positions(blocks, [0, 5], ["block_id", "block_size"])
    return ids.withColumn("block_size", F.col("block_size").cast("bigint"))


@_query("csv_header_scan", "select n_nationkey::bigint as id, n_name as data_tier from nation")
def _csv_header_scan(spark, sf_dir):
    path = _shared_path(spark, "tiers")
    _tiers(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_catalogue(spark, path, schemas.TIER_NAMES, header=True)


_SOME_MONTHS = [f"2000-{m:02}" for m in range(1, 13)] + ["1900-01"]


@_query(
    "month_partition_scan",
    _transfers_sql("true", _OWN_DATE, f"select * from matrix where year_month in ({str(_SOME_MONTHS)[1:-1]})"),
)
def _month_partition_scan(spark, sf_dir):
    path = _shared_path(spark, "matrix")
    sinks.write_table(_transfer_matrix(spark, sf_dir), path, ["year_month"])
    return transfer_jobs.load_transfers(spark, path, _SOME_MONTHS)


@_query("daily_table_scan", _daily_blocks_sql(_FILE_OPENS, "opens", "site_name, is_crab"))
def _daily_table_scan(spark, sf_dir):
    opened = _daily_blocks(spark, sf_dir, "cmssw", _file_open_log(spark, sf_dir))
    return _as_text(_written(spark, "daily", opened), "working_set_blocks")


@_query("any_format_scan", "select * replace (epoch_us(ts) as ts) from events")
def _any_format_scan(spark, sf_dir):
    path = _shared_path(spark, "json-events")
    events = _table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    events.write.json(path)
    return readers.read_any(spark, f"/mounted{path}", schema=events.schema, prefix="/mounted")


@_query("replaced_table", "select * from orders")
def _replaced_table(spark, sf_dir):
    path = _shared_path(spark, "orders")
    orders = _table(spark, sf_dir, "orders")
    sinks.write_table(orders.select(F.lit("old").alias("o_orderkey")), path)
    sinks.write_table(orders, path)
    return readers.read_daily(spark, path)


@_query(
    "months_replaced",
    """select strftime(o_orderdate, '%Y-%m') as year_month, o_orderkey,
        case when o_orderdate >= timestamp '1998-01-01' then 'new' else 'old' end as version from orders""",
)
def _months_replaced(spark, sf_dir):
    """A rerun of some months leaves the others as they are."""
    path = _shared_path(spark, "months")
    orders = _table(spark, sf_dir, "orders").select(
        fn.month_text("o_orderdate").alias("year_month"), "o_orderkey"
    )
    sinks.write_table(orders.withColumn("version", F.lit("old")), path, ["year_month"])
    rerun = orders.where(F.col("year_month") >= "1998-01").withColumn("version", F.lit("new"))
    sinks.write_table(rerun, path, ["year_month"])
    return readers.read_months(spark, path, schemas.table("o_orderkey bigint, version string, year_month string"))


@_query("built_once_sizes", f"select block as _size_item, size as _size from ({_PART_SIZES})")
def _built_once_sizes(spark, sf_dir):
    table = lookups.size_table(_part_sizes(spark, sf_dir), "b_block_id", "b_block_size")
    return sinks.build_once(table, _shared_path(spark, "sizes"))


@_query(
    "text_dump",
    """select *, to_json({p_partkey: p_partkey, p_name: p_name, p_brand: p_brand, p_type: p_type, p_size: p_size})::varchar
        as line from part""",
)
def _text_dump(spark, sf_dir):
    """Every line of the dump with the row it holds; numbers with a fraction are compared as such, not as text."""
    path = _shared_path(spark, "part")
    parts = _table(spark, sf_dir, "part")
    sinks.write_table(parts, path)
    sinks.dump_text(spark, path, f"{path}-text")
    lines = spark.read.text(f"{path}-text").select("value", F.from_json("value", parts.schema).alias("row"))
    return lines.select("row.*", F.regexp_replace("value", ',"p_retailprice":[^,}]*', "").alias("line"))


def _sample_facts(source: DataFrame, drawn: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """What holds for any fair sample: rows of the source, none twice, and the same ones for the same seed."""
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*key).alias("n_keys")).select(
        "n",
        (F.col("n") == F.col("n_keys")).alias("no_row_twice"),
        drawn.exceptAll(source).agg(F.count(F.lit(1)) == 0).scalar().alias("all_from_source"),
        drawn.exceptAll(again).agg(F.count(F.lit(1)) == 0).scalar().alias("same_for_a_seed"),
    )


@_query(
    "sample_rows",
    "select true as size_within_bounds, true as no_row_twice, true as all_from_source, true as same_for_a_seed from events limit 1",
)
def _sample_rows(spark, sf_dir):
    """Eight standard deviations around the size that was asked for."""
    events = _table(spark, sf_dir, "events")
    drawn, again = (sampling.sample_rows(events, 100, seed=1) for _ in range(2))
    facts = _sample_facts(events, drawn, again, ["event_id"])
    return facts.select(F.col("n").between(20, 180).alias("size_within_bounds"), "no_row_twice", "all_from_source", "same_for_a_seed")


@_query(
    "sample_written",
    "select true as size_within_bounds, true as no_row_twice, true as all_from_source from events limit 1",
)
def _sample_written(spark, sf_dir):
    """The sampling job from files to files: JSON lines whose form is inferred, a sample of them, read back."""
    path = _shared_path(spark, "sample")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    events.write.json(f"{path}-json")
    sampling.run_sample(spark, f"/mounted{path}-json", f"{path}-drawn", 100, prefix="/mounted", seed=2)
    drawn = spark.read.schema(events.schema).json(f"{path}-drawn")
    facts = _sample_facts(events, drawn, drawn, ["event_id"])
    return facts.select(F.col("n").between(20, 180).alias("size_within_bounds"), "no_row_twice", "all_from_source")


@_query("sample_all", "select event_id, user_id from events")
def _sample_all(spark, sf_dir):
    """A sample that asks for more rows than there are."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_rows(events, 10**12, seed=1)


@_query(
    "sample_exactly",
    """select count(*) as n, true as no_row_twice, true as all_from_source, true as same_for_a_seed
    from (select * from events limit 1000)""",
)
def _sample_exactly(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    drawn, again = (sampling.sample_exactly(events, 1000, seed=1) for _ in range(2))
    return _sample_facts(events, drawn, again, ["event_id"])


# --- contract -------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: daily footprint and recalls for the four lifetimes."""
    return _rolling_footprint(spark, "/root/testdata/sf0.001")


def _llm() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the text operators; none if that subpackage, or a library that it needs, cannot be imported."""
    try:
        import corpus_pipeline
        from tidemark.llm import queries as text_queries
    except ImportError as missing:
        warnings.warn(f"without the text operators: {missing}", stacklevel=2)
        return {}, {}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return text_queries.QUERIES | {"pipeline": corpus_pipeline.run}, text_queries.ORACLES | sql


def queries() -> dict[str, Query]:
    return _QUERIES | _llm()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _llm()[1]
