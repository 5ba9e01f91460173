"""Keys that hold a large share of all rows, so that only their rows are split over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in SHARE of all rows is heavy; so there are fewer than SHARE of them.
SHARE = 1000
#: Fewer rows than these are no load for one task.
LEAST_ROWS = 50_000
#: Into how many parts a heavy key's rows are split.
SALTS = 32


def heavy_keys(rows: DataFrame, *key: str, least: int = LEAST_ROWS) -> list[int]:
    """Hashes of the keys with more than one in SHARE of all rows and more than least rows, fewer than SHARE of them.

    One pass with a sketch of fixed size in each task and no shuffle of keys. The sketch may miss a key or take in one
    that is none: that changes how rows are spread, never a result.
    """
    hashed = rows.select(F.xxhash64(*key).alias("k"))
    found = hashed.agg(F.expr(f"approx_top_k(k, {SHARE}, {20 * SHARE})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] > max(found["n"] / SHARE, least)]


def _is_heavy(heavy: list[int], *key: str) -> Column:
    return F.xxhash64(*key).isin(heavy) if heavy else F.lit(False)


def salt(heavy: list[int], key: list[str], spread: list[str], salts: int = SALTS) -> Column:
    """Part of a row on the side with many rows per key: by a hash of spread for heavy keys, 0 for others."""
    return F.when(_is_heavy(heavy, *key), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)


def all_salts(heavy: list[int], key: list[str], salts: int = SALTS) -> Column:
    """Parts of a row on the side with one row per key, to be exploded: every part for heavy keys, 0 for others."""
    return F.when(_is_heavy(heavy, *key), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
