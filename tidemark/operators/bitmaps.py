"""Sets of whole numbers as bitmaps: one row of 4 KB for each 32,768 ids of a group that has members among them.

A group of any size is rows of bounded size, spread over tasks by group and bucket. Unions, intersections and sizes
work on these rows without one row per member. Ids that lie densely pay off most; for a few ids spread
thinly over their range the long form (``sets``) is smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the two columns of a bitmap row.
BUCKET, BITS = "bucket", "bits"
#: Ids of a bucket, and bytes of its bitmap.
BUCKET_IDS = 32_768
_BYTES = BUCKET_IDS // 8
#: Bits of a filter of names: 16 MB, and for 10 million names about one false one in fourteen.
FILTER_BITS = 1 << 27
#: Bytes that are looked at together when a bitmap is opened.
_STRETCH = 64


def to_bitmaps(members: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Long form (keys, item) to ``(keys, bucket, bits)``; repeats count once.

    A group whose members are all NULL, such as an empty set, keeps a row with a NULL bucket. Bits are set in a map-side step, so that a
    hot group sends one bitmap per task and bucket.
    """
    some = F.col(item).isNotNull()
    bucket = F.when(some, F.bitmap_bucket_number(F.col(item).cast("bigint")))
    place = F.when(some, F.bitmap_bit_position(F.col(item).cast("bigint")))
    rows = members.groupBy(*keys, bucket.alias(BUCKET)).agg(F.bitmap_construct_agg(place).alias(BITS))
    return rows.select(*keys, BUCKET, F.when(F.col(BUCKET).isNotNull(), F.col(BITS)).alias(BITS))


def union(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of all sets that share the keys, whatever other columns told them apart."""
    rows = bitmaps.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    return rows.select(*keys, BUCKET, F.when(F.col(BUCKET).isNotNull(), F.col(BITS)).alias(BITS))


def intersection(bitmaps: DataFrame, keys: Sequence[str], n_sets: int) -> DataFrame:
    """Members that all of ``n_sets`` sets with these keys have; a set has one row per bucket (as ``union`` leaves it).

    A bucket that some set lacks has no common member. Groups whose sets share nothing have no rows.
    """
    rows = bitmaps.where(F.col(BUCKET).isNotNull()).groupBy(*keys, BUCKET)
    common = rows.agg(F.bitmap_and_agg(BITS).alias(BITS), F.count(F.lit(1)).alias("_n"))
    return common.where((F.col("_n") == n_sets) & (F.bitmap_count(BITS) > 0)).select(*keys, BUCKET, BITS)


def sizes(bitmaps: DataFrame, keys: Sequence[str], out: str = "n_items") -> DataFrame:
    """Members of every group of disjoint rows (as ``to_bitmaps`` and ``union`` leave them), 0 for an empty set."""
    return bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).cast("bigint").alias(out))


def union_sizes(bitmaps: DataFrame, keys: Sequence[str], out: str = "n_items") -> DataFrame:
    """Size of the union of all sets that share the keys: unions per bucket first, then sums over few rows."""
    return sizes(union(bitmaps, keys), keys, out)


def name_filter(names: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of one hash over the values of a column, as bitmaps: at most ``bits / 8`` bytes, whatever the number of names."""
    place = F.pmod(F.xxhash64(name), F.lit(bits)) + 1
    return to_bitmaps(names.where(F.col(name).isNotNull()).select(place.alias("_place")), [], "_place")


def possible_names(df: DataFrame, name: str, known: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose name may be among those of the filter ``known``: all that are, and few others.

    The filter is bounded by its bits (16 MB by default), and so is broadcast: the rows are left out where they are read, before any shuffle.
    """
    place = F.pmod(F.xxhash64(name), F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    filters = known.select(F.col(BUCKET).alias("_bucket"), F.col(BITS).alias("_bits"))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.call_function("getbit", octet, (at % 8).cast("int")) == 1
    joined = df.join(F.broadcast(filters), F.bitmap_bucket_number(place) == F.col("_bucket"))
    return joined.where(may).select(*df.columns)


def _slices(of: Column, n: int, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.substring(of, i * width + 1, F.lit(width)).alias("part"))
    )


def to_members(bitmaps: DataFrame, keys: Sequence[str], item: str, keep_empty: bool = False) -> DataFrame:
    """``(keys, item)``, one row per member; with ``keep_empty`` an empty set leaves a NULL.

    Bitmaps are opened from stretches of bytes to bytes to bits, and stretches without any bit are left out on the way, within
    generated code and without a shuffle.
    """
    none = F.lit(bytes(_STRETCH))
    stretches = bitmaps.where(F.col(BUCKET).isNotNull()).select(*keys, BUCKET, F.inline(_slices(F.col(BITS), _BYTES // _STRETCH, _STRETCH)))
    stretches = stretches.where(F.col("part") != none).select(*keys, BUCKET, F.col("i").alias("_s"), F.col("part").alias("_stretch"))
    octets = stretches.select(*keys, BUCKET, "_s", F.inline(_slices(F.col("_stretch"), _STRETCH, 1))).where(F.col("part") != F.lit(bytes(1)))
    value = F.conv(F.hex("part"), 16, 10).cast("int")
    first = (F.col("_s") * _STRETCH + F.col("i")) * 8
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("getbit", F.col("_v"), k) == 1)
    places = octets.select(*keys, BUCKET, first.alias("_first"), value.alias("_v")).select(*keys, BUCKET, "_first", F.explode(bits).alias("_k"))
    place = F.col("_first") + F.col("_k")
    # Spark counts the places of positive ids from 1 up, those of others from 0 down.
    ident = F.when(F.col(BUCKET) > 0, (F.col(BUCKET) - 1) * BUCKET_IDS + place + 1).otherwise(F.col(BUCKET) * BUCKET_IDS - place)
    members = places.select(*keys, ident.cast("bigint").alias(item))
    if keep_empty:
        # A set is empty if its only rows have no bucket.
        full = F.max(F.col(BUCKET)).alias("_full")
        empty = bitmaps.groupBy(*keys).agg(full).where("_full is null")
        members = members.unionByName(empty.select(*keys, F.lit(None).cast("bigint").alias(item)))
    return members
