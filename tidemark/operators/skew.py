"""Joins on keys of which a few make up much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent_keys(df: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """Keys that make up at least ``share`` of the rows: exact, and at most ``1 / share`` of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).select("n").scalar()
    return counts.where(F.col("_n") >= F.lit(share) * total).select(key)


#: Keys that a sketch tracks: it finds every key with more than about one in so many of the rows.
TRACKED = 10_000


def sketch(key: Column | str, tracked: int = TRACKED) -> Column:
    """Aggregate: a mergeable sketch of the frequent values of ``key``, of bounded size however many keys there are."""
    return F.call_function("approx_top_k_accumulate", F.col(key) if isinstance(key, str) else key, F.lit(tracked))


def sketched_keys(sketches: DataFrame, key: str, share: float = 0.001, sketch_col: str = "sketch", rows_col: str = "n_rows") -> DataFrame:
    """Keys that make up about ``share`` of the rows of all sketches together, at most ``1 / share`` of them.

    ``sketches`` has a sketch and the number of its rows in each row, such as one per month. The keys are a hint for
    ``spread_join``, whose result does not depend on them.
    """
    together = sketches.agg(
        F.call_function("approx_top_k_combine", F.col(sketch_col), F.lit(TRACKED)).alias("_s"), F.sum(rows_col).alias("_n")
    )
    top = F.call_function("approx_top_k_estimate", F.col("_s"), F.lit(max(1, int(1 / share))))
    found = together.select("_n", F.explode(top).alias("_k")).where(F.col("_k.count") >= F.lit(share) * F.col("_n"))
    return found.select(F.col("_k.item").alias(key)).where(F.col(key).isNotNull())


def spread_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: DataFrame
) -> DataFrame:
    """Inner join whose shuffle is even although the keys in ``hot`` are frequent on the left.

    ``hot`` is one column of keys, few enough to broadcast, such as ``frequent_keys`` gives; ``right``
    has about one row per key; keys have any one type. Left rows with a hot key find their partner in the broadcast
    right rows of those keys. They then go through the shuffle of the other rows, so that the left side
    is read once, but with a salt that spreads them and matches nothing. The salt is a hash of the
    whole row and the number of its partition, so that copies of one row are spread as well; a task that
    runs again sees both again and sends its rows to the same places.
    The result does not depend on which keys ``hot`` names. Columns: the left ones and the
    right ones without the key.
    """
    others = [c for c in right.columns if c != right_key]
    names = hot.select(F.col(hot.columns[0]).alias(right_key)).distinct()
    hot_right = right.join(F.broadcast(names), right_key, "left_semi").select(
        F.col(right_key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in others]
    )
    cold_right = right.select(
        F.col(right_key).alias("_cold_key"),
        # Always 0, but no literal: the optimizer would take a literal out of the join's keys.
        F.pmod(F.xxhash64(right_key), F.lit(1)).alias("_no_salt"),
        *[F.col(c).alias(f"_cold_{c}") for c in others],
    )
    is_hot = F.col("_hot_key").isNotNull()
    row = F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.lit(1 << 40)) + 1
    return (
        left.join(F.broadcast(hot_right), F.col(left_key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(is_hot, row).otherwise(F.lit(0).cast("long")))
        .join(cold_right, (F.col(left_key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_no_salt")), "left")
        .where(is_hot | F.col("_cold_key").isNotNull())
        .select(
            *left.columns,
            *[
                F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c)
                for c in others
            ],
        )
    )
