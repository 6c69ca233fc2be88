"""Text columns: dataset paths, host and node names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide which rows fall into which group.
CAMPAIGN_PATTERN = r"^/[^/]*/((?:HI|PA|PN|XeXe|)Run201\d\w-[^-]+|CMSSW_\d+|[^-]+)[^/]*/"
AOD_TIER_PATTERN = "(|MINI|NANO)AOD"
GRID_TOOL_MARK = ":crab:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def campaign(dataset_path: Column | str, pattern: str = CAMPAIGN_PATTERN) -> Column:
    """Campaign part of a ``/primary/processed/tier`` path; '' without a match, NULL for NULL."""
    return F.regexp_extract(_col(dataset_path), pattern, 1)


def contains_flag(text: Column | str, mark: str = GRID_TOOL_MARK) -> Column:
    """Whether the text holds a mark: true, false, or NULL for NULL."""
    return _col(text).contains(mark)


def drop_bracketed(host: Column | str, suffix: str = "]") -> Column:
    """NULL for hosts that end in ``suffix`` (bracketed addresses), else the host."""
    h = _col(host)
    return F.when(h.endswith(suffix), F.lit(None)).otherwise(h)


def tier_matches(tier: Column | str, pattern: str = AOD_TIER_PATTERN) -> Column:
    """Regex test anchored at the start of the text only."""
    return _col(tier).rlike(f"^(?:{pattern})")


def last_label(host: Column | str) -> Column:
    """Last dotted label of a host; a host without a dot is returned whole."""
    return F.substring_index(_col(host), ".", -1)


def node_country(node: Column | str) -> Column:
    """Second ``_`` field of a storage node name, lower-cased; the whole name without ``_``."""
    head = F.substring_index(_col(node), "_", 2)
    return F.lower(F.substring_index(head, "_", -1))


# The wording of the labels below, which reports show.
def route_label(client: Column | str, server: Column | str) -> Column:
    """``from <client> to <server>``."""
    return F.concat(F.lit("from "), _col(client), F.lit(" to "), _col(server))


def necessity_label(
    available: Column | str, client: Column | str, server: Column | str
) -> Column:
    """Say whether a replica near the client made the transfer unnecessary."""
    a, c, s = _col(available), _col(client), _col(server)
    route = F.concat(c, F.lit("-"), s, F.lit(" transfer"))
    return F.when(
        a, F.concat(F.lit("block available in "), c, F.lit(" = unnecessary "), route)
    ).otherwise(
        F.concat(F.lit("block not available in "), c, F.lit(" = necessary "), route)
    )
