"""Newest rows and two versions of a keyed table: carry over, differences, anti joins both ways, appends of unseen keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest values of order, nulls counting as least.

    A max over a struct combines on the map side, so a hot key sends one row per task; key values may be null
    (null is a key of its own). Rows equal in all order columns: the greatest of the remaining columns that can be
    ordered is not defined, so order must end in a unique column.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(packed.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def carry_over(new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """new with the old value of each column where there is one."""
    kept = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return new.join(kept, list(keys), "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, change, old, new): keys added, removed or with another value, null being a value."""
    a = before.select(*keys, F.col(column).alias("old"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(column).alias("new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"), "old", "new").where(F.col("change").isNotNull())


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()  # noqa: E741
    return l.join(r, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, list(keys), "left_anti").withColumn("side", F.lit("right")))


def append_unseen(batch: DataFrame, there: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of batch to append: keys not there yet, the first by order where the batch repeats one."""
    from cluemill.operators.activity import first_per

    return first_per(batch.join(there.select(*keys).distinct(), list(keys), "left_anti"), keys, order).select(*batch.columns)


def fingerprint(rows: DataFrame, keys: Sequence[str], parts: Sequence[Column], digits: int = 12) -> DataFrame:
    """(keys, fingerprint): sha1 over a key's parts in sorted order. Meant for keys with few rows, such as packets."""
    line = F.concat_ws("|", *parts)
    return rows.groupBy(*keys).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")), 1, digits).alias("fingerprint"))
