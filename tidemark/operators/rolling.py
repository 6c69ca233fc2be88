"""Rolling footprint: which items are held on each day, and which come back.

An access on day ``a`` keeps an item in the set on the days ``a .. a + L`` (that is
``L + 1`` days) for a lookback of ``L`` days. An item's covers merge into stays. A
stay that starts is a recall; a stay that ends takes the item out again. The daily
state is then a running sum over starts and ends, so the cost is linear in the
distinct (item, day) pairs and does not depend on ``L``.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeline import SECONDS_PER_DAY
from tidemark.operators.counts import Counts
from tidemark.operators.lookups import with_size

# The named lifetimes in days ("6m" is 120), and 2016-01-01 as a day number.
LOOKBACKS = {"1w": 7, "1m": 30, "3m": 90, "6m": 120}
FIRST_DAY = 1451606400 // SECONDS_PER_DAY

MEASURES = ("n_items", "ws_size", "n_recalls", "recall_size")


def fixed_axis(now: float | None = None, first_day: int = FIRST_DAY) -> tuple[int, int]:
    """Inclusive day numbers from ``first_day`` to two days before ``now`` (UNIX seconds).

    Only this helper reads the clock; pass its result on, so that a query
    itself gives the same answer whenever it runs.
    """
    seconds = time.time() if now is None else now
    return first_day, int(seconds // SECONDS_PER_DAY) - 2


def data_axis(df: DataFrame, day: str = "day") -> tuple[Column, Column]:
    """First and last day present, as scalar subqueries that the query itself evaluates."""
    limits = df.agg(F.min(day).cast("int").alias("lo"), F.max(day).cast("int").alias("hi"))
    return limits.select("lo").scalar(), limits.select("hi").scalar()


def axis_bounds(axis, df: DataFrame, day: str = "day") -> tuple[Column, Column]:
    """First and last day of an axis given as a pair, as a DataFrame with days, or as None for ``df``."""
    if axis is None:
        return data_axis(df, day)
    if isinstance(axis, DataFrame):
        return data_axis(axis, day)
    lo, hi = axis
    return tuple(F.lit(x).cast("int") if isinstance(x, int) else x for x in (lo, hi))


def dense_days(df: DataFrame, axis=None, day: str = "day") -> DataFrame:
    """One row per day of the axis, without gaps."""
    lo, hi = axis_bounds(axis, df, day)
    one = df.sparkSession.range(1)
    # An axis without any day gives no rows (sequence would count backwards).
    return one.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias(day))


def fill_days(
    daily: DataFrame, measures: Sequence[str], axis=None, day: str = "day"
) -> DataFrame:
    """Daily measures on the dense axis, zero where a day has none."""
    return dense_days(daily, axis, day).join(daily, day, "left").select(
        day, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
    )


def _lookback_days(lookbacks) -> list[int]:
    days = lookbacks.values() if isinstance(lookbacks, Mapping) else lookbacks
    return sorted(set(int(d) for d in days))


def _touched(
    accesses: DataFrame, item: str, day: str, scope: Sequence[str], limits: tuple | None
) -> DataFrame:
    """Distinct (scope, item, day); without ``limits`` the days are known to be on the axis."""
    return _on_days(accesses, item, day, scope, limits).distinct()


def _on_days(
    accesses: DataFrame, item: str, day: str, scope: Sequence[str], limits: tuple | None
) -> DataFrame:
    """(scope, item, day) of the accesses that name an item, as in ``_touched``; rows may repeat."""
    on_axis = F.col(day).isNotNull() if limits is None else F.col(day).between(*limits)
    return accesses.where(F.col(item).isNotNull() & on_axis).select(*scope, item, F.col(day).cast("int").alias("_day"))


def _dealt(touched: DataFrame, item: str) -> DataFrame:
    """The rows dealt by their item to as many partitions as the session has for a shuffle.

    With a number, adaptive execution does not merge them: it would go by their size before they are spread over scopes and lookbacks and sorted.
    """
    return touched.repartition(int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions")), item)


def _with_total(touched: DataFrame, scope: Sequence[str], total: str, where: Column) -> DataFrame:
    """The rows, and those that meet ``where`` once more under the scope ``total``."""
    (name,) = scope
    both = F.when(where, F.array(F.col(name), F.lit(total))).otherwise(F.array(F.col(name)))
    others = [c for c in touched.columns if c != name]
    return touched.select(F.explode(both).alias(name), *others)


def _stay_edges(touched: DataFrame, item: str, scope: Sequence[str], days: list[int]) -> DataFrame:
    """Rows with ``lookback_days``, ``_starts`` and ``_ends``.

    The window runs once for all lookbacks: only the gap to the neighbouring access
    matters, whatever L is. An item has at most one row per scope and day in its window, even the most
    popular one; in that of a total, one per scope. Equal rows are next to each other, a gap of 0, and start and end a stay once.
    """
    # The item comes first: Spark sorts by the first column's bits, and a scope is the same text on most rows.
    order = Window.partitionBy(item, *scope).orderBy("_day")
    before = F.col("_day") - F.lag("_day").over(order)
    after = F.lead("_day").over(order) - F.col("_day")

    def apart(gap: str, limit) -> Column:
        return F.col(gap).isNull() | (F.col(gap) > limit)

    shortest = F.lit(min(days) + 1)
    limit = F.col("lookback_days") + 1
    return (
        touched.withColumn("_before", before)
        .withColumn("_after", after)
        # Inner days of a stay under the shortest lookback are inner days under all.
        .where(apart("_before", shortest) | apart("_after", shortest))
        .withColumn("lookback_days", F.explode(F.array(*[F.lit(d) for d in days])))
        .withColumn("_starts", apart("_before", limit))
        .withColumn("_ends", apart("_after", limit))
        .where(F.col("_starts") | F.col("_ends"))
    )


def stays(
    accesses: DataFrame,
    item: str,
    day: str = "day",
    scope: Sequence[str] = (),
    lookbacks=LOOKBACKS,
    axis=None,
) -> DataFrame:
    """The rolling set itself, as intervals.

    One row per uninterrupted stay: ``(scope, lookback_days, item, first_day,
    last_day)``, both inclusive and clipped to the axis. An item is in the set of a
    day exactly if one of its stays covers that day.
    """
    lo, hi = axis_bounds(axis, accesses, day)
    days = _lookback_days(lookbacks)
    touched = _touched(accesses, item, day, scope, None if axis is None else (lo, hi))
    edges = _stay_edges(touched, item, scope, days)
    order = Window.partitionBy(*scope, item, "lookback_days").orderBy("_day")
    # A start is followed by its own end, on the same row or on the next one.
    last = F.when(F.col("_ends"), F.col("_day")).otherwise(F.lead("_day").over(order))
    return (
        edges.withColumn("_last", last)
        .where("_starts")
        .select(
            *scope,
            "lookback_days",
            item,
            F.col("_day").alias("first_day"),
            F.least(F.col("_last") + F.col("lookback_days"), hi).alias("last_day"),
        )
    )


def rolling_footprint(
    accesses: DataFrame,
    item: str,
    day: str = "day",
    scope: Sequence[str] = (),
    sizes: DataFrame | None = None,
    size_item: str = "b_block_id",
    size: str = "b_block_size",
    lookbacks=LOOKBACKS,
    axis=None,
    scopes: DataFrame | None = None,
    counts: Counts | None = None,
    total: str | None = None,
) -> DataFrame:
    """Daily footprint and recalls per scope and lookback, on a dense day axis.

    Returns ``(scope, lookback_days, day, n_items, ws_size, n_recalls, recall_size)``.
    ``accesses`` has one row per access or per distinct access, with an int day number.
    ``axis`` is a pair of inclusive day numbers, a DataFrame whose days span the axis,
    or None for the span of the ``accesses`` that name an item, which is then read off the distinct accesses
    and costs no further look at the input; accesses outside it do not count. Items that ``sizes``
    does not list count with 0 bytes. ``scopes`` lists scopes that must appear even
    without accesses; without scope columns the one series always appears. ``counts`` learns how many distinct (scope, item, day)
    rows have an item without a size. ``total`` names a further scope (of one scope column) that takes the accesses of all; they get their second
    rows only behind the shuffle by item, which serves the sizes and the windows alike.
    """
    days = _lookback_days(lookbacks)
    lookback = F.explode(F.array(*[F.lit(d) for d in days])).alias("lookback_days")

    if axis is None:
        touched = _touched(accesses, item, day, scope, None)
        # The limits come from the distinct accesses' own shuffle. Spark would take the distinct out from under a plain minimum
        # and look at the input again; under a count it leaves it in place.
        limits = touched.agg(F.min("_day").alias("lo"), F.max("_day").alias("hi"), F.count(F.lit(1)).alias("n"))
        lo, hi = (limits.select(F.when(F.col("n") > 0, F.col(c))).scalar() for c in ("lo", "hi"))
    else:
        lo, hi = axis_bounds(axis, accesses, day)
        touched = _touched(accesses, item, day, scope, (lo, hi))
    touched = _dealt(touched, item)
    if total is not None:
        touched = _with_total(touched, scope, total, F.lit(True))
        # Rows are only told apart where they are counted.
        touched = touched.distinct() if counts is not None else touched
    if sizes is None:
        touched = touched.withColumn("_size", F.lit(0).cast("bigint"))
    else:
        touched = with_size(touched, item, sizes, size_item, size, "_size", counts)

    edges = _stay_edges(touched, item, scope, days)
    one, zero, bytes_ = F.lit(1), F.lit(0), F.col("_size")

    def event(at: Column, items: Column, size_: Column, recalls: Column, recalled: Column) -> Column:
        return F.struct(
            at.alias("_at"),
            items.cast("bigint").alias("_items"),
            size_.cast("bigint").alias("_bytes"),
            recalls.cast("bigint").alias("n_recalls"),
            recalled.cast("bigint").alias("recall_size"),
        )

    start = F.when(F.col("_starts"), event(F.col("_day"), one, bytes_, one, bytes_))
    end = F.when(
        F.col("_ends"),
        event(F.col("_day") + F.col("lookback_days") + 1, -one, -bytes_, zero, zero),
    )
    events = edges.select(
        *scope, "lookback_days", F.explode(F.array(start, end)).alias("_event")
    ).select(*scope, "lookback_days", "_event.*")

    # Events of zero at the first day make sure that a scope has a series at all.
    blank = scopes.select(*scope).distinct() if scopes is not None else None
    if not scope:
        blank = accesses.sparkSession.range(1).select()
    if blank is not None:
        events = events.unionByName(
            blank.select(*scope, lookback).select(
                *scope, "lookback_days", event(lo, zero, zero, zero, zero).alias("_event")
            ).select(*scope, "lookback_days", "_event.*")
        )

    per_day = (
        events.where(F.col("_at") <= hi)
        .groupBy(*scope, "lookback_days", "_at")
        .agg(*[F.sum(c).alias(c) for c in ("_items", "_bytes", "n_recalls", "recall_size")])
    )
    return _on_every_day(per_day, scope, lo, hi, day)


def _on_every_day(
    per_day: DataFrame, scope: Sequence[str], lo: Column, hi: Column, day: str
) -> DataFrame:
    """Running sums over the event days, carried forward to every day of the axis.

    Each event row is stretched to the day before the next event, and the
    first one back to the start of the axis, so no spine has to be joined. A
    window holds at most one row per day of the axis.
    """
    order = Window.partitionBy(*scope, "lookback_days").orderBy("_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.lag("_at").over(order).isNull()
    stretched = per_day.select(
        *scope,
        "lookback_days",
        "_at",
        F.sum("_items").over(so_far).alias("_held"),
        F.sum("_bytes").over(so_far).alias("_held_size"),
        "n_recalls",
        "recall_size",
        F.when(first, lo).otherwise(F.col("_at")).alias("_from"),
        (F.coalesce(F.lead("_at").over(order), hi + 1) - 1).alias("_to"),
    ).withColumn(day, F.explode(F.sequence("_from", "_to")))
    zero = F.lit(0).cast("bigint")
    reached = F.col(day) >= F.col("_at")
    on_event = F.col(day) == F.col("_at")
    return stretched.select(
        *scope,
        "lookback_days",
        day,
        F.when(reached, F.col("_held")).otherwise(zero).alias("n_items"),
        F.when(reached, F.col("_held_size")).otherwise(zero).alias("ws_size"),
        F.when(on_event, F.col("n_recalls")).otherwise(zero).alias("n_recalls"),
        F.when(on_event, F.col("recall_size")).otherwise(zero).alias("recall_size"),
    )
