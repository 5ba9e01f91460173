"""State over time: as-of lookups, readings of windows that turn over, progress that arrives, pushes that change something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cluemill.operators.activity import micros


def as_of(asked: DataFrame, readings: DataFrame, keys: Sequence[str], at: str, value: str, within_s: int) -> DataFrame:
    """asked with the newest reading of its key at or before its time, if it is not older than within_s, and that one's time.

    Both sides are put together and sorted once per key and day; what carries over from earlier days is one row per key
    and day, so a key with a third of all rows is as many tasks as it has days. Readings at the same time: the greatest.
    """
    kept = [c for c in asked.columns]
    left = asked.select(*kept, F.lit(None).cast("struct<t: bigint, v: double>").alias("_r"), F.lit(1).alias("_side"))
    reading = F.struct(micros(at).alias("t"), F.col(value).cast("double").alias("v"))
    right = readings.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in kept], reading.alias("_r"), F.lit(0).alias("_side"))
    both = left.unionByName(right).withColumn("_day", F.to_date(at))
    inside = Window.partitionBy(*keys, "_day").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_here", F.max("_r").over(inside))
    days = both.groupBy(*keys, "_day").agg(F.max("_r").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_day").alias("_d"), F.max("_last").over(before).alias("_before"))
    same = F.col("_day") == F.col("_d")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    found = rows.where("_side = 1").join(carried, same).withColumn("_found", F.coalesce("_here", "_before"))
    fresh = micros(at) - F.col("_found.t") <= within_s * 1_000_000
    return found.select(*kept, F.when(fresh, F.col("_found.v")).alias("reading"), F.when(fresh, F.col("_found.t")).alias("reading_us"))


def rolled_reset(resets: Column, now: Column, window_us: int) -> tuple[Column, Column]:
    """(next reset, whether it is derived), in microseconds: a passed reset rolls forward by one window and is then derived;
    one that passed more than a window ago tells nothing."""
    derived = resets <= now
    rolled = F.when(derived, resets + window_us).otherwise(resets)
    return F.when(rolled > now, rolled), F.when(rolled > now, derived)


def unsealed(events: DataFrame, arrived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events whose keys were not there when the state arrived: what is there on opening counts as reported already."""
    return events.join(arrived.select(*keys).distinct(), list(keys), "left_anti")


def to_push(mine: DataFrame, remote: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of mine that the remote lacks or holds otherwise, by one hash of the columns in fixed order; null is a value."""
    print_of = F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    there = remote.select(*keys, print_of.alias("_there"))
    return mine.withColumn("_mine", print_of).join(there, list(keys), "left").where(F.col("_there").isNull() | (F.col("_there") != F.col("_mine"))).drop("_mine", "_there")
