"""References to records that do not exist (problem 2).

A reference is a row (table_name, row_key, field_name, ref_value, target, ref_key, at): the row's field names a record
of target by ref_key at the time at. A target row is (target, ref_key, loaded_at, removed_at); a target row whose
loaded_at is null was always there, one whose removed_at is null is there for good.

``cascade`` goes down the foreign-key graph to the fixpoint. Its step 0, ``direct_orphans``, finds each reference that
did not lead to a record at its time, with the reason. Every further step takes the references to records that have a
row orphaned in the step before: their rows are inherited orphans of the next depth, until a step finds none.

Defined results: a null or blank ref_key is no reference, and a target row without a key is no target. A reference without a time can be missing only. A null
loaded_at of the target counts as always there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.operators.skew import all_salts, heavy_keys, salt
from cluemill.session import materialize

REFERENCE_COLUMNS = ["table_name", "row_key", "field_name", "ref_value", "target", "ref_key", "at"]
#: Under which name and key the referring row is itself a record that others refer to; null where it is none.
OWN_COLUMNS = ["own_target", "own_key"]


def presence(targets: DataFrame) -> DataFrame:
    """One row per target record: when it first came, and from when on it is there for good (null: never).

    Both are minima, so a hot key is combined on the map side.
    """
    loaded = F.coalesce("loaded_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    return targets.groupBy("target", "ref_key").agg(
        F.min(loaded).alias("first_there"),
        F.min(F.when(F.col("removed_at").isNull(), loaded)).alias("there_for_good"),
    )


def direct_orphans(references: DataFrame, targets: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """References that led nowhere at their time, with reason missing, late or deleted, and the columns carried.

    The lookup joins on (target, key, salt): the references of a key that holds a large share of them are spread over
    parts, and its record stands once per part; other keys have one part. Only references made after the first and
    before the last stay of their record meet the single stays, in an anti join.
    """
    key = ["target", "ref_key"]
    refs = references.where(F.col("ref_key").isNotNull())
    heavy = heavy_keys(refs, *key)
    refs = refs.withColumn("salt", salt(heavy, key, ["row_key", "ref_value"]))
    there = presence(targets).withColumn("salt", F.explode(all_salts(heavy, key)))
    looked = refs.join(there, [*key, "salt"], "left")
    reason = (
        F.when(F.col("first_there").isNull(), "missing")
        .when(F.col("first_there") > F.col("at"), "late")
        .when((F.col("there_for_good") <= F.col("at")) | F.col("at").isNull(), None)
        .otherwise("deleted")
    )
    suspects = looked.select(*REFERENCE_COLUMNS, *carried, "salt", reason.alias("reason")).where(F.col("reason").isNotNull())
    stays = targets.where(F.col("removed_at").isNotNull()).select(
        *key, F.coalesce("loaded_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("_from"), F.col("removed_at").alias("_to"),
    ).where(F.col("_from") < F.col("_to")).distinct().withColumn("_s", F.explode(all_salts(heavy, key))).withColumnsRenamed({"target": "_t", "ref_key": "_k"})
    alive = (F.col("target") == F.col("_t")) & (F.col("ref_key") == F.col("_k")) & (F.col("salt") == F.col("_s")) & (F.col("reason") == "deleted") & (F.col("_from") <= F.col("at")) & (F.col("_to") > F.col("at"))
    return suspects.join(stays, alive, "left_anti").select(*REFERENCE_COLUMNS, *carried, "reason")


def cascade(references: DataFrame, targets: DataFrame, record_targets: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """REFERENCE_COLUMNS, reason and depth of every orphan reference: of depth 0 for direct ones, of depth n and reason
    inherited for those of rows first orphaned in step n, to the records orphaned in the step before.

    references: with OWN_COLUMNS; record_targets: the targets whose records have references of their own. A row's
    reference to its own key passes nothing on. Only references to such targets can pass anything on; they are written
    once. Each step is a semi-join of them with the distinct keys that the step before orphaned, less the rows found
    before; the steps' results are written apart and put together once. It ends when a step finds nothing; every row
    is found in one step, so it ends. max_depth stops earlier.
    """
    row, key = ["table_name", "row_key"], ["target", "ref_key"]
    columns = [*REFERENCE_COLUMNS, *OWN_COLUMNS, "reason", "depth"]
    steps = [materialize(direct_orphans(references, targets, OWN_COLUMNS).withColumn("depth", F.lit(0)).select(*columns))]
    if max_depth == 0:
        return steps[0].drop(*OWN_COLUMNS)
    other = F.col("own_key").isNull() | (F.col("own_key") != F.col("ref_key")) | (F.col("own_target") != F.col("target"))
    passing = materialize(references.where(F.col("target").isin(*record_targets) & F.col("ref_key").isNotNull() & other).select(*REFERENCE_COLUMNS, *OWN_COLUMNS))
    heavy = heavy_keys(passing, *key)
    links = passing.withColumn("salt", salt(heavy, key, row))
    while (max_depth is None or len(steps) <= max_depth) and not steps[-1].isEmpty():
        found = steps[0].select(*row)
        for step in steps[1:]:
            found = found.unionByName(step.select(*row))
        keys = steps[-1].where("own_key IS NOT NULL").select(F.col("own_target").alias("target"), F.col("own_key").alias("ref_key")).distinct().withColumn("salt", F.explode(all_salts(heavy, key)))
        new = links.join(keys, [*key, "salt"], "left_semi").join(found.distinct(), row, "left_anti")
        steps.append(materialize(new.withColumn("reason", F.lit("inherited")).withColumn("depth", F.lit(len(steps))).select(*columns)))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.drop(*OWN_COLUMNS)


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")
