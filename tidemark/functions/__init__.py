"""Column functions: every function takes and returns a Spark column."""

from tidemark.functions.regions import (
    host_region,
    label_region,
    node_region,
    region_labels,
)
from tidemark.functions.text import (
    campaign,
    contains_flag,
    drop_bracketed,
    last_label,
    necessity_label,
    node_country,
    route_label,
    tier_matches,
)
from tidemark.functions.timeline import (
    date_text,
    datetime_text,
    day_date,
    day_number,
    day_start,
    millis_to_seconds,
    month_text,
    ntz_seconds,
)

__all__ = [
    "campaign",
    "contains_flag",
    "date_text",
    "datetime_text",
    "day_date",
    "day_number",
    "day_start",
    "drop_bracketed",
    "host_region",
    "label_region",
    "last_label",
    "millis_to_seconds",
    "month_text",
    "necessity_label",
    "node_country",
    "node_region",
    "ntz_seconds",
    "region_labels",
    "route_label",
    "tier_matches",
]
