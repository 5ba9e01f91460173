"""Scores against a baseline: z-scores with renormalised weights, bands, percentiles, rank correlation, permutation tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cluemill.session import materialize


def baseline(rows: DataFrame, components: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation (0 where fewer than two values) of each component."""
    return rows.agg(*[x for c in components for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_sd"))])


def weighted_z(rows: DataFrame, base: DataFrame, weights: Mapping[str, float], score: str = "score") -> DataFrame:
    """rows with score: weighted mean of the z-scores of the components that are there; null where none is.

    A missing component is dropped and the other weights are renormalised; one without spread counts as 0. base is the
    single row of baseline, read by the driver and set into the plan as constants.
    """
    frozen = base.first()
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        sd = frozen[f"{c}_sd"]
        z = (F.col(c) - frozen[f"{c}_mean"]) / sd if sd else F.lit(0.0)
        total = total + F.when(F.col(c).isNotNull(), z * w).otherwise(0.0)
        weight = weight + F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    return rows.withColumn(score, F.when(weight > 0, total / weight))


def band(score: Column, cuts: Sequence[tuple[float, str]], above: str) -> Column:
    """Name of the first band whose upper end exceeds the score; null for null."""
    out = F.when(score.isNull(), None)
    for end, name in cuts:
        out = out.when(score < end, name)
    return out.otherwise(above)


def rank_counts(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, below, total): for each distinct value how many rows hold it and how many hold less.

    The sums run over distinct values: over range-partitioned blocks first and then over the blocks' totals, so no task
    sorts all rows or all values. The blocks are written once, so that both steps see the same ones.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    blocks = materialize(counts.repartitionByRange(F.col(value)).withColumn("_block", F.spark_partition_id()))
    inside = Window.partitionBy("_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    part = blocks.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # one row per block: as many as shuffle partitions
    sums = blocks.groupBy("_block").agg(F.sum("n").alias("_n"), F.min(value).alias("_from"))
    order = Window.orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return part.join(F.broadcast(before), "_block").select(value, "n", (F.col("_inside") + F.col("_before")).alias("below"), "total")


def percentile(rows: DataFrame, value: str) -> DataFrame:
    """rows with percentile: round half even of 100 times the share of the others that are strictly below; null for one row or a null value."""
    ranks = rank_counts(rows, value)
    share = F.when(F.col("total") > 1, F.expr("CAST(bround(100 * below / (total - 1)) AS INT)"))
    return rows.join(ranks, value, "left").select(*rows.columns, share.alias("percentile"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation of tie-averaged ranks over rows where both values are there."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rank = lambda v: rank_counts(rows, v).select(v, (F.col("below") + (F.col("n") + 1) / 2).alias(f"{v}_rank"))
    return rows.join(rank(x), x).join(rank(y), y).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(f"{x}_rank", f"{y}_rank"), 6).alias("rho"))


def permutation_p(spark: SparkSession, a: Sequence[float], b: Sequence[float], trials: int = 20_000, seed: int = 20) -> DataFrame:
    """permutation_p_of_counts of two small samples."""
    values, at = np.unique([*a, *b], return_inverse=True)
    in_a, in_b = (np.bincount(x, minlength=len(values)) for x in (at[: len(a)], at[len(a) :]))
    return permutation_p_of_counts(spark, values, in_a, in_b, trials, seed)


def permutation_p_of_counts(spark: SparkSession, values: Sequence[float], in_a: Sequence[int], in_b: Sequence[int], trials: int = 20_000, seed: int = 20) -> DataFrame:
    """One row: difference of the means of two samples and (hits + 1) / (trials + 1) over shuffles of all their members, spread over tasks.

    The samples are given by how often each holds each distinct value. A shuffle deals the first sample's size out of
    all members, so how often it gets each value is one draw of the multivariate hypergeometric distribution: the same
    test as shuffling the members one by one, at the cost of the distinct values.
    """
    values, in_a, in_b = np.array(values, float), np.array(in_a, np.int64), np.array(in_b, np.int64)
    both, n, m = in_a + in_b, in_a.sum(), in_b.sum()
    sums = values @ both
    seen = abs(values @ in_a / n - (sums - values @ in_a) / m) if n and m else float("nan")

    def run(batches):
        for pdf in batches:
            hits = 0
            for block, size in zip(pdf["block"], pdf["size"]):
                rng = np.random.default_rng([seed, block])
                for _ in range(size if n and m else 0):
                    dealt = values @ rng.multivariate_hypergeometric(both, n, method="marginals")
                    hits += abs(dealt / n - (sums - dealt) / m) >= seen - 1e-12
            yield pd.DataFrame({"hits": [hits]})

    size = 500
    blocks = [(k, min(size, trials - k * size)) for k in range(-(-trials // size))]
    counted = spark.createDataFrame(blocks, "block int, size int").repartition(8).mapInPandas(run, "hits bigint")
    return counted.agg(((F.sum("hits") + 1) / (trials + 1)).alias("p")).select(F.lit(float(seen)).alias("difference"), "p", F.lit(trials).alias("trials"))


def permutation_of(spark: SparkSession, a: Sequence[float], b: Sequence[float], statistic: Callable[[np.ndarray, np.ndarray], float], trials: int = 20_000, seed: int = 20) -> DataFrame:
    """One row as permutation_p, for any statistic of two samples of bounded size: (hits + 1) / (trials + 1) over shuffles whose
    statistic is at least as far from 0 as the one seen."""
    both, n = np.array([*a, *b], float), len(a)
    seen = abs(statistic(both[:n], both[n:])) if n and len(b) else float("nan")

    def run(batches):
        for pdf in batches:
            hits = 0
            for block, size in zip(pdf["block"], pdf["size"]):
                rng = np.random.default_rng([seed, block])
                for _ in range(size if seen == seen else 0):
                    dealt = rng.permutation(both)
                    hits += abs(statistic(dealt[:n], dealt[n:])) >= seen - 1e-12
            yield pd.DataFrame({"hits": [hits]})

    size = 500
    blocks = [(k, min(size, trials - k * size)) for k in range(-(-trials // size))]
    counted = spark.createDataFrame(blocks, "block int, size int").repartition(8).mapInPandas(run, "hits bigint")
    return counted.agg(((F.sum("hits") + 1) / (trials + 1)).alias("p")).select(F.lit(float(seen)).alias("statistic"), "p", F.lit(trials).alias("trials"))
