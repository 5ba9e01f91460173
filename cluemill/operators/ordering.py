"""A total order over all rows without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cluemill.session import materialize


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """rows with their place (from 1) in the total order; order must have no ties.

    Range-partitions, numbers inside each partition, and adds the sizes of the partitions before: one offset row per
    shuffle partition is all that is broadcast. The partitioned rows are written once, for the bounds are sampled and
    the sizes must be those of the same partitions.
    """
    blocks = materialize(rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return blocks.withColumn("_inside", inside).join(F.broadcast(offsets), "_block").select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def neighbours(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """(key, position, previous, next) in the total order."""
    at = numbered(rows.select(*dict.fromkeys([key, *rows.columns])), order).select(key, "position")
    side = lambda name, step: at.select(F.col(key).alias(name), (F.col("position") + step).alias("position"))
    return at.join(side("previous", 1), "position", "left").join(side("next", -1), "position", "left").select(key, "position", "previous", "next")


def value_quantiles(rows: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """(keys, percent, value): element int(n p / 100) of each key's sorted values, by counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = upto.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("_at", F.least(F.floor(F.col("_n") * F.col("percent") / 100), F.col("_n") - 1))
    return at.where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_c"))).select(*keys, "percent", F.col(value).alias("value"))
