"""Event streams: vocabulary filter, daily counts, once per name and session, merged saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Events of the Parquet files of a folder, as a stream; the time with its zone, as watermarks need it."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def file_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Rows of the Parquet files of a folder whose names match, as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def merge_stream(pushes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table of merged saves after a stream of pushes: each batch is merged into a new version of the table.

    Merging takes greatest and least values only, so a batch that comes late or again changes nothing it should not, and
    no watermark drops anything.
    """
    import uuid

    from cluemill.operators.merge import merge_saves, upsert

    spark = pushes.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/merged-{uuid.uuid4().hex}"
    newest: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        at = f"{base}/version={number}"
        merged = upsert(spark.read.parquet(newest[-1]), batch, keys) if newest else merge_saves(batch, keys).drop("n_pushes")
        merged.write.mode("overwrite").parquet(at)
        newest.append(at)

    pushes.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(newest[-1]) if newest else merge_saves(spark.createDataFrame([], pushes.schema), keys).drop("n_pushes")


#: Most bytes of an event's body.
MOST_BYTES = 32


def known(events: DataFrame, vocabulary: Sequence[str], body: str = "props", most: int = MOST_BYTES) -> DataFrame:
    """Events of the vocabulary's names whose body is not too long; others are silently left out, a null body is none."""
    return events.where(F.col("event_type").isin(*vocabulary) & (F.coalesce(F.octet_length(body), F.lit(0)) <= most))


def daily_counts(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def once_per(events: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """The first event of each key to arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its table, written to the shared checkpoint folder."""
    import uuid

    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        def write(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out")

        writer = stream.writeStream.foreachBatch(write)
    writer.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
