"""Frequency of every distinct term, over occurrences and records, with bounds (problem 4).

Every record emits its own term counts, Spark's hash aggregate combines them on the map side, and only
(field, term) partial sums are shuffled, so a term that fills a third of all rows arrives as one row per map task.
The counts are written once: the totals, which the common bound needs, are read from their few rows without a term.

Defined results: null arrays, null terms and blank terms count nowhere; a record without terms still counts as a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.functions.text import term_key
from cluemill.session import materialize


def term_counts(records: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field_name, term, occurrences, records) over all records.

    fields gives each field's array of raw terms per record. Null arrays, null terms and terms of white space
    only count nowhere. A record without terms still counts as a record, as the row with a null term of each field.
    """
    def per_record(raw: Column) -> Column:
        terms = F.filter(F.transform(raw, term_key), lambda t: t.isNotNull())
        counted = F.transform(
            F.array_distinct(terms),
            lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda x: x == t)).cast("long").alias("n")),
        )
        whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("n")))
        return F.concat(whole, F.coalesce(counted, F.array().cast("array<struct<term:string,n:bigint>>")))

    def tagged(name: str, raw: Column) -> Column:
        return F.transform(per_record(raw), lambda x: F.struct(F.lit(name).alias("field_name"), x["term"].alias("term"), x["n"].alias("n")))

    cells = records.select(F.explode(F.concat(*[tagged(name, raw) for name, raw in fields.items()])).alias("cell")).select("cell.*")
    return cells.groupBy("field_name", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def mark_terms(counts: DataFrame, rare_below: int, common_percent: int) -> DataFrame:
    """counts of term_counts with the number of records and the marks rare and common.

    The counts are written once, so records are broken up and counted in one pass. The total stands in the null-term
    row of each field; it is joined back by field_name: one row per field, so the broadcast is bounded by the field list.
    """
    counts = materialize(counts)
    totals = counts.where(F.col("term").isNull()).select("field_name", F.col("records").alias("all_records"))
    terms = counts.where(F.col("term").isNotNull())
    return terms.join(F.broadcast(totals), "field_name").select(
        "field_name", "term", "occurrences", "records", "all_records",
        (F.col("records") < rare_below).alias("is_rare"),
        (F.col("records") * 100 > F.col("all_records") * common_percent).alias("is_common"),
    )
