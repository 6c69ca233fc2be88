"""Host and storage-node names to regions.

A name's region follows from its top-level label; a label that is not in the table has no region. Any other table
can be passed as ``labels``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import last_label, node_country

# Which top-level labels belong to which region.
EU_LABELS = """
    ad al ar at ba be bg by ch cy cz de dk ee es eu fi fr gi gr hr hu ie im it li lt lu lv mc md me mk mt
    nl no pl pt ro rs se si sk ua uk va
""".split()
US_LABELS = "org net edu gov mil ca us".split()
OTHER_LABELS = """
    com int arpa ac ae af ag ai am ao aq as au aw ax az bb bd bf bh bi bj bm bn bo br bs bt bw bz cc cd
    cf cg ci ck cl cm cn co cr cu cv cw cx dj dm do dz ec eg er et fj fk fm fo ga gd ge gf gh gl gm gn
    gp gq gs gt gu gw gy hk hm hn ht id il in io iq ir is je jm jo jp ke kg kh ki km kn kp kr kw ky kz
    la lb lc lk lr ls ly ma mg mh ml mn mo mp mq mr ms mu mv mw mx my mz na nc ne nf ng ni np nr nu nz
    om pa pe pf pg ph pk pm pn pr ps pw py qa re ru rw sa sb sc sd sg sh sl sm sn so sr st su sv sx sy
    sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ug uy uz vc ve vg vi vn vu wf ws ye yt za zm zw
""".split()


def region_labels() -> dict[str, str]:
    """The label -> region table."""
    regions = {"eu": EU_LABELS, "us": US_LABELS, "other": OTHER_LABELS}
    return {label: region for region, labels in regions.items() for label in labels}


def label_region(label: Column | str, labels: Mapping[str, str] | None = None) -> Column:
    """Region of a label, NULL if unknown; labels are case-sensitive.

    There is one membership test per region: Spark turns a long list of literals into a hash set, where a
    map literal would be searched entry by entry for each row.
    """
    table = region_labels() if labels is None else labels
    label = F.col(label) if isinstance(label, str) else label
    out = F.lit(None).cast("string")
    for region in sorted(set(table.values()), reverse=True):
        out = F.when(label.isin([k for k in table if table[k] == region]), region).otherwise(out)
    return out


def host_region(host: Column | str, labels: Mapping[str, str] | None = None) -> Column:
    """Region of a host or domain, by its last label."""
    return label_region(last_label(host), labels)


def node_region(node: Column | str, labels: Mapping[str, str] | None = None) -> Column:
    """Region of a storage node, by its country field."""
    return label_region(node_country(node), labels)
