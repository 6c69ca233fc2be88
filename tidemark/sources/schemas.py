"""Table schemas, all declared: no read infers a schema.

Every integer is a bigint, since the source ids have up to 38 digits and sizes are
summed exactly. Column order is that of the headerless CSV files.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def table(columns: str) -> T.StructType:
    """Schema from lines or comma-separated items of ``name type``."""
    fields = [item.split() for item in columns.replace("\n", ",").split(",") if item.strip()]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


def record(data: T.StructType) -> T.StructType:
    """Schema of a log record, whose fields sit in one ``data`` struct."""
    return T.StructType([T.StructField("data", data, True)])


# Names, order and types of the columns of the catalogue and record tables.

PROCESSING_ERAS = table("""
    processing_era_id bigint
    processing_version string
    creation_date bigint
    create_by string
    description string
""")

ACQUISITION_ERAS = table("""
    acquisition_era_id bigint
    acquisition_era_name string
    start_date bigint
    end_date bigint
    creation_date bigint
    create_by string
    description string
""")

DATASET_ACCESS_TYPES = table("""
    dataset_access_type_id bigint
    dataset_access_type string
""")

DATA_TIERS = table("""
    data_tier_id bigint
    data_tier_name string
    data_tier_creation_date double
    data_tier_create_by string
""")

DATASETS = table("""
    d_dataset_id bigint
    d_dataset string
    d_is_dataset_valid bigint
    d_primary_ds_id bigint
    d_processed_ds_id bigint
    d_data_tier_id bigint
    d_dataset_access_type_id bigint
    d_acquisition_era_id bigint
    d_processing_era_id bigint
    d_physics_group_id bigint
    d_xtcrosssection double
    d_prep_id string
    d_creation_date double
    d_create_by string
    d_last_modification_date double
    d_last_modified_by string
""")

# The size column is read as double and cast where it is summed: files hold it in either form.
BLOCKS = table("""
    b_block_id bigint
    b_block_name string
    b_dataset_id bigint
    b_open_for_writing bigint
    b_origin_site_name string
    b_block_size double
    b_file_count bigint
    b_creation_date double
    b_create_by string
    b_last_modification_date double
    b_last_modified_by string
""")

FILES = table("""
    f_file_id bigint
    f_logical_file_name string
    f_is_file_valid bigint
    f_dataset_id bigint
    f_block_id bigint
    f_file_type_id bigint
    f_check_sum string
    f_event_count bigint
    f_file_size double
    f_branch_hash_id bigint
    f_adler32 string
    f_md5 string
    f_auto_cross_section double
    f_creation_date double
    f_create_by string
    f_last_modification_date double
    f_last_modified_by string
""")

DATASET_OUTPUT_CONFIGS = table("""
    mc_ds_output_mod_config_id bigint
    mc_dataset_id bigint
    mc_output_mod_config_id bigint
""")

OUTPUT_CONFIGS = table("""
    oc_output_mod_config_id bigint
    oc_app_exec_id bigint
    oc_release_version_id bigint
    oc_parameter_set_hash_id bigint
    oc_output_module_label string
    oc_global_tag string
    oc_scenario string
    oc_creation_date bigint
    oc_create_by string
""")

RELEASE_VERSIONS = table("""
    r_release_version_id bigint
    r_release_version string
""")

FILE_LUMIS = table("""
    fl_run_num bigint
    fl_lumi_section_num string
    fl_file_id bigint
""")

REPLICA_SUMMARY = table("""
    date bigint
    site string
    dataset string
    size bigint
    replica_date bigint
""")

REPLICAS = table("""
    now_sec double
    dataset_name string
    dataset_id bigint
    dataset_is_open string
    dataset_time_create double
    dataset_time_update double
    block_name string
    block_id bigint
    block_files bigint
    block_bytes bigint
    block_is_open string
    block_time_create double
    block_time_update double
    node_name string
    node_id bigint
    br_is_active string
    br_src_files bigint
    br_src_bytes bigint
    br_dest_files bigint
    br_dest_bytes bigint
    br_node_files bigint
    br_node_bytes bigint
    br_xfer_files bigint
    br_xfer_bytes bigint
    br_is_custodial string
    br_user_group_id bigint
    replica_time_create double
    replica_time_updater double
""")

DATASET_REPLICAS = table("""
    dataset_name string
    evts bigint
    size double
    date double
    dataset_access_type string
    acquisition_era_name string
    r_release_version string
    node_name string
    pbr_size double
    dataset_is_open string
    max_replica_time double
""")

FILE_OPEN_RECORDS = table("""
    UNIQUE_ID string
    FILE_LFN string
    FILE_SIZE string
    CLIENT_DOMAIN string
    CLIENT_HOST string
    SERVER_DOMAIN string
    SERVER_HOST string
    SITE_NAME string
    READ_BYTES_AT_CLOSE string
    READ_BYTES string
    READ_SINGLE_BYTES string
    READ_SINGLE_OPERATIONS string
    READ_SINGLE_AVERAGE string
    READ_SINGLE_SIGMA string
    READ_VECTOR_BYTES string
    READ_VECTOR_OPERATIONS string
    READ_VECTOR_AVERAGE string
    READ_VECTOR_SIGMA string
    READ_VECTOR_COUNT_AVERAGE string
    READ_VECTOR_COUNT_SIGMA string
    USER_DN string
    APP_INFO string
    START_TIME string
    END_TIME string
    START_DATE bigint
    END_DATE bigint
    INSERT_DATE bigint
""")

JOB_MONITORING_RECORDS = table("""
    JobId string
    FileName string
    IsParentFile string
    ProtocolUsed string
    SuccessFlag string
    FileType string
    LumiRanges string
    StrippedFiles string
    BlockId string
    StrippedBlocks string
    BlockName string
    InputCollection string
    Application string
    ApplicationVersion string
    Type string
    GenericType string
    NewGenericType string
    NewType string
    SubmissionTool string
    InputSE string
    TargetCE string
    SiteName string
    SchedulerName string
    JobMonitorId string
    TaskJobId string
    SchedulerJobIdV2 string
    TaskId string
    TaskMonitorId string
    NEventsPerJob string
    NTaskSteps string
    JobExecExitCode string
    JobExecExitTimeStamp bigint
    StartedRunningTimeStamp bigint
    FinishedTimeStamp bigint
    WrapWC string
    WrapCPU string
    ExeCPU string
    NCores string
    NEvProc string
    NEvReq string
    WNHostName string
    JobType string
    UserId string
    GridName string
""")

STAGE_OUT_RECORDS = table("""
    tm_id string
    tm_username string
    tm_taskname string
    tm_destination string
    tm_destination_lfn string
    tm_source string
    tm_source_lfn string
    tm_filesize double
    tm_publish double
    tm_jobid bigint
    tm_job_retry_count bigint
    tm_type string
    tm_aso_worker string
    tm_transfer_retry_count bigint
    tm_transfer_max_retry_count bigint
    tm_publication_retry_count bigint
    tm_publication_max_retry_count bigint
    tm_rest_host string
    tm_rest_uri string
    tm_transfer_state bigint
    tm_publication_state bigint
    tm_transfer_failure_reason string
    tm_publication_failure_reason string
    tm_fts_id string
    tm_fts_instance string
    tm_last_update double
    tm_start_time double
    tm_end_time double
""")

AGGREGATED_ACCESSES = table("""
    dn string
    dataset_name string
    site_name string
    app string
    uid bigint
    stream string
    timestamp bigint
    nacc bigint
    distinct_users bigint
    site_tier string
    cpu_time double
    wc_time double
    primary_name string
    processing_name string
    data_tier string
""")

EMPTY_REMOTE_ACCESSES = table("""
    src_experiment_site string
    user_dn string
    file_lfn string
""")

EMPTY_DISK_POOL_ACCESSES = table("""
    file_lfn string
    user_dn string
    host string
""")

# Headered CSV that names the tiers.
TIER_NAMES = table("""
    id bigint
    data_tier string
""")

# The fields of the access logs that the jobs use.

BATCH_JOB_ADS = record(table("""
    DESIRED_CMSDataset string
    RecordTime bigint
    Site string
    CMS_SubmissionTool string
    Status string
"""))

FILE_OPEN_REPORTS = record(table("""
    file_lfn string
    end_time bigint
    app_info string
    site_name string
"""))

REMOTE_ACCESS_REPORTS = record(table("""
    file_lfn string
    end_time bigint
    client_domain string
    vo string
"""))

TRANSFER_REPORTS = record(table("""
    file_lfn string
    start_time bigint
    client_domain string
    client_host string
    server_domain string
    operation string
    read_bytes bigint
    write_bytes bigint
"""))

JOB_REPORTS = record(
    T.StructType([
        T.StructField("meta_data", table("jobstate string, ts bigint"), True),
        T.StructField("steps", T.ArrayType(table("site string")), True),
        T.StructField("LFNArray", T.ArrayType(T.StringType()), True),
    ])
)

# The monthly transfer table, partitioned by its last column.
TRANSFER_MATRIX = table("""
    server_location string
    client_location string
    dataset_at_client_location boolean
    total_read_bytes bigint
    year_month string
""")

CATALOGUE_TABLES = {
    "processing_eras": PROCESSING_ERAS,
    "acquisition_eras": ACQUISITION_ERAS,
    "dataset_access_types": DATASET_ACCESS_TYPES,
    "data_tiers": DATA_TIERS,
    "datasets": DATASETS,
    "blocks": BLOCKS,
    "files": FILES,
    "dataset_output_configs": DATASET_OUTPUT_CONFIGS,
    "output_configs": OUTPUT_CONFIGS,
    "release_versions": RELEASE_VERSIONS,
    "file_lumis": FILE_LUMIS,
    "replica_summary": REPLICA_SUMMARY,
    "replicas": REPLICAS,
    "dataset_replicas": DATASET_REPLICAS,
    "file_open_records": FILE_OPEN_RECORDS,
    "job_monitoring_records": JOB_MONITORING_RECORDS,
    "stage_out_records": STAGE_OUT_RECORDS,
    "aggregated_accesses": AGGREGATED_ACCESSES,
    "empty_remote_accesses": EMPTY_REMOTE_ACCESSES,
    "empty_disk_pool_accesses": EMPTY_DISK_POOL_ACCESSES,
}
