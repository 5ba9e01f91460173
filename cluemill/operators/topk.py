"""The first k rows of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, parts: int = 8) -> DataFrame:
    """Rows with place 1 to k within their key; order must have no ties.

    Each key is first cut to k rows in each of several parts, so a key with a third of all rows is sorted in parts and
    no task meets more than parts times k rows of it at the end.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    cut = rows.withColumn("_part", part).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k).drop("_part", "_r")
