"""Reports over event logs: pivots, funnels, sessions, active time, first wins, running gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(c: str) -> Column:
    """Microseconds since 1970 of a time as it is written, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def daily_pivot(events: DataFrame, at: str, name: str, vocabulary: Sequence[str]) -> DataFrame:
    """Events per day, a column per name of the vocabulary in its order and one for all others; 0 where a day has none."""
    other = F.count_if(~F.coalesce(F.col(name).isin(*vocabulary), F.lit(False))).alias("other")
    return events.groupBy(F.to_date(at).alias("day")).agg(*[F.count_if(F.col(name) == v).alias(v) for v in vocabulary], other)


def funnel(events: DataFrame, name: str, opening: str) -> DataFrame:
    """Events of each name and their share of the opening ones; null share where nothing was opened."""
    totals = events.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # one row per name of the vocabulary: the window holds the few totals, not the events
    opened = F.sum(F.when(F.col("name") == opening, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return totals.select("name", "n", F.round(F.col("n") / opened, 6).alias("share"))


def last_active_days(events: DataFrame, at: str, n: int) -> DataFrame:
    """Events of the last n days that have any. Ranks distinct days only, so the one ordered partition is days long."""
    per_day = events.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.orderBy(F.col("day").desc()).limit(n)


def with_session(events: DataFrame, keys: Sequence[str], at: str, tie: str, idle_s: int) -> DataFrame:
    """events with session_no (from 1) and gap_us: a gap longer than idle_s begins a session.

    Works by day: a key's events are sorted within each day only, and what carries over (the last event before, the
    sessions begun before) runs over one row per key and day. So a key with a third of all rows is as many tasks as it
    has days. Null keys are keys of their own.
    """
    day = F.to_date(at)
    us, idle = micros(at), idle_s * 1_000_000
    inside = Window.partitionBy(*keys, "_day").orderBy(at, tie)
    rows = events.withColumn("_day", day).withColumn("_gap", us - F.lag(us).over(inside)).withColumn("_begun", F.sum(F.when(F.col("_gap") > idle, 1).otherwise(0)).over(inside))
    days = rows.groupBy(*keys, "_day").agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.max("_begun").alias("_inside"))
    order = Window.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("_carry", F.col("_first") - F.lag("_last").over(order))
    new = F.when(F.col("_carry").isNull() | (F.col("_carry") > idle), 1).otherwise(0)
    days = days.withColumn("_before", F.sum(F.col("_inside") + new).over(order) - F.col("_inside"))
    carried = days.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_day").alias("_d"), "_carry", "_before")
    same = F.col("_day") == F.col("_d")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(carried, same).select(*events.columns, F.coalesce("_gap", "_carry").alias("gap_us"), (F.col("_before") + F.col("_begun")).alias("session_no"))


def active_time(events: DataFrame, keys: Sequence[str], at: str, tie: str, idle_s: int) -> DataFrame:
    """Sum of the gaps between events that follow one another within idle_s."""
    gaps = with_session(events, keys, at, tie, idle_s)
    counts = (F.col("gap_us") > 0) & (F.col("gap_us") <= idle_s * 1_000_000)
    return gaps.groupBy(*keys).agg(F.sum(F.when(counts, F.col("gap_us")).otherwise(0)).alias("active_us"), F.max("session_no").alias("n_sessions"))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, with map-side combining instead of a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def running_gate(readings: DataFrame, window_key: str, at: str, tie: str, value: str, limit: float) -> DataFrame:
    """A reading is a lower bound for the rest of its window: the verdict of each is over once the running maximum passed the limit."""
    order = Window.partitionBy(window_key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    high = F.max(value).over(order)
    return readings.withColumn("high", high).withColumn("verdict", F.when(F.col("high").isNull(), "unknown").when(F.col("high") >= limit, "over").otherwise("under"))


def suppress_repeats(rows: DataFrame, keys: Sequence[str], at: str, tie: str, within_s: int) -> DataFrame:
    """Rows not preceded by one of the same keys within within_s."""
    gap = micros(at) - F.lag(micros(at)).over(Window.partitionBy(*keys).orderBy(at, tie))
    return rows.withColumn("gap_us", gap).where(F.col("gap_us").isNull() | (F.col("gap_us") > within_s * 1_000_000))
