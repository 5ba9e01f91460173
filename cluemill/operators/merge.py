"""Merge of per-key, time-stamped updates with deletions and resets, for any number of sources at once.

Every rule is a max, min or set union, so the result does not depend on the order, repetition or partitioning of the
rows, and all of them combine on the map side. The reset barrier is the one rule that pairwise merging gets wrong: the
greatest reset is found first and each row is tested by its own stamp.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writer_wins(updates: DataFrame, owner: Sequence[str], cell: str, stamp: str, value: str, deleted: Column, reset: Column) -> DataFrame:
    """(owner, cell, stamp, value, deleted): the newest update of each cell not before its owner's last reset.

    At equal stamps a value beats a deletion, and the greater value wins. Rows of a reset have no cell. Null cells,
    stamps and owners are left out.
    """
    rows = updates.select(*owner, F.col(cell).alias("_cell"), F.col(stamp).alias("_stamp"), F.col(value).alias("_value"), deleted.alias("_deleted"), reset.alias("_reset")).dropna(subset=[*owner, "_stamp"])
    barrier = rows.where("_reset").groupBy(*owner).agg(F.max("_stamp").alias("_cleared"))
    newest = rows.where(~F.col("_reset") & F.col("_cell").isNotNull()).groupBy(*owner, "_cell").agg(F.max(F.struct("_stamp", (~F.col("_deleted")).alias("present"), "_value")).alias("m"))
    live = newest.join(barrier, list(owner), "left").where(F.col("_cleared").isNull() | (F.col("m._stamp") >= F.col("_cleared")))
    return live.select(*owner, F.col("_cell").alias(cell), F.col("m._stamp").alias(stamp), F.when(F.col("m.present"), F.col("m._value")).alias(value), (~F.col("m.present")).alias("deleted"))


def merge_saves(saves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of pushed saves: most letters, most reveals, most active time, first solving, newest update."""
    return saves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pushes"), F.max("letters_typed").alias("letters_typed"), F.max("reveals_used").alias("reveals_used"),
        F.max("active_ms").alias("active_ms"), F.min("solved_at").alias("solved_at"), F.max("updated_at").alias("updated_at"),
    )


def merge_hints(saves: DataFrame, keys: Sequence[str], hints: str) -> DataFrame:
    """(keys, entry_id, rungs): union of the hints shown per entry, sorted."""
    shown = saves.select(*keys, F.explode(hints).alias("entry_id", "shown")).select(*keys, "entry_id", F.explode("shown").alias("rung"))
    return shown.groupBy(*keys, "entry_id").agg(F.array_sort(F.collect_set("rung")).alias("rungs"))


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge of a table of merged saves with a batch of pushes: merging is idempotent, so a batch given again adds nothing but pushes."""
    both = table.drop("n_pushes").unionByName(batch.select(*[c for c in table.columns if c != "n_pushes"]))
    return merge_saves(both, keys).drop("n_pushes")
