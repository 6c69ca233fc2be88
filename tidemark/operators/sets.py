"""Set algebra on id sets.

The engine's own form of a set is *long*: one row per member, so that a set of
any size is spread over tasks. The array form (one row per set) is kept for
sets that already fit in a row, and for reading and writing tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- one set per row -------------------------------------------------------

def as_set(items: Column | str) -> Column:
    """Array to a sorted set without duplicates."""
    return F.sort_array(F.array_distinct(items))


def set_union(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_union(a, b))


def set_difference(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_except(a, b))


def set_intersection(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_intersect(a, b))


# --- one member per row ----------------------------------------------------

def union_rows(*frames: DataFrame) -> DataFrame:
    """Union of any number of long sets with equal columns.

    One flat union and one distinct, whose partial step removes most
    duplicates before the shuffle.
    """
    return reduce(DataFrame.unionByName, frames).distinct()


def difference_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of ``a`` that are not in ``b``; NULLs compare as equal."""
    return a.subtract(b.select(*a.columns))


def intersection_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both; NULLs compare as equal."""
    return a.intersect(b.select(*a.columns))


def bag_union(*frames: DataFrame) -> DataFrame:
    """Append tables whose columns differ; a missing column becomes NULL."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )


# --- between the two forms -------------------------------------------------

def to_members(sets: DataFrame, keys: Sequence[str], array: str, item: str) -> DataFrame:
    """Array form to long form.

    A group with an empty or NULL array keeps one row with a NULL member, so no
    group is lost; pieces of a split set flow together again.
    """
    return sets.select(*keys, F.explode_outer(array).alias(item)).distinct()


#: Pieces of each set in array form, unless told otherwise.
PIECES = 8


def to_arrays(members: DataFrame, keys: Sequence[str], item: str, array: str, pieces: int = PIECES) -> DataFrame:
    """Long form to array form: ``(keys, piece, array)``, with the sorted members of each piece.

    Every group, whatever its size, is dealt by a hash of the member to ``pieces`` pieces, numbered from 0, so that no task or
    row holds a whole large group; one piece is for groups known to fit in a row. NULL members are skipped. Pieces without members have
    no row, but for piece 0 of an empty group. ``to_members`` puts the pieces together again. Large sets
    of whole numbers are better kept as bitmaps (see ``bitmaps``), whose rows are bounded whatever the group.
    """
    some = F.col(item).isNotNull()
    own = F.when(some, F.pmod(F.xxhash64(item), F.lit(pieces)).cast("int")).otherwise(F.lit(0))
    filled = members.groupBy(*keys, own.alias("piece")).agg(F.sort_array(F.collect_set(item)).alias(array))
    if pieces == 1:
        return filled
    # A group whose members are all NULL keeps its empty piece 0; other groups lose theirs, unless it has members.
    empty = members.groupBy(*keys).agg(F.count(item).alias("_n")).where("_n = 0").select(*keys, F.lit(0).alias("piece"))
    none = F.array().cast(filled.schema[array].dataType)
    return filled.where(F.size(array) > 0).unionByName(empty.select(*keys, "piece", none.alias(array)))


def daily_union(sets: DataFrame, keys: Sequence[str], array: str, item: str) -> DataFrame:
    """Union of all the sets that share the keys, one row per member.

    Empty sets add nothing: a key whose sets are all empty has no members.
    """
    return sets.select(*keys, F.explode(array).alias(item)).distinct()


def expand_members(
    members: DataFrame,
    item: str,
    mapping: DataFrame,
    mapping_item: str,
    part: str,
    keep_empty: bool = True,
    distinct: bool = True,
) -> DataFrame:
    """Replace every member by the parts it consists of (dataset -> blocks).

    With ``keep_empty``, a member without parts leaves a NULL, so its group stays, as an empty
    set. Callers that remove duplicates later on anyway can save a shuffle with ``distinct=False``.

    The parts come from an inner join, and the members without any from an anti join with the
    distinct wholes. A single outer join would say the same, but adaptive execution could not
    split its right side, where one whole may have a large share of all parts.
    """
    pairs = mapping.select(F.col(mapping_item).alias("_whole"), F.col(part).alias("_part"))
    keep = [c for c in members.columns if c != item]
    same = F.col(item) == F.col("_whole")
    parts = members.join(pairs, same).select(*keep, F.col("_part").alias(part))
    if keep_empty:
        nothing = F.lit(None).cast(pairs.schema["_part"].dataType).alias(part)
        wholes = pairs.select("_whole").distinct()
        parts = parts.unionByName(
            members.join(wholes, same, "left_anti").select(*keep, nothing)
        )
    return parts.distinct() if distinct else parts


def item_map(
    mapping: DataFrame,
    whole: str,
    part: str,
    array: str,
    pieces: int = PIECES,
) -> DataFrame:
    """Set of parts per whole (dataset -> set of blocks), in pieces (see ``to_arrays``)."""
    return to_arrays(mapping, [whole], part, array, pieces)
