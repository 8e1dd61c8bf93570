"""Streaming ingest of observations: an extension; its result equals the batch merge of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph.operators.corpus import merge_scalars


def observation_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files that arrive in `folder`, read with a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, store: str, checkpoint: str):
    """Appends each micro-batch to the observation store under its epoch; a replayed epoch overwrites itself.

    Observations are never changed, so late data is harmless: the canonical record is an aggregate keyed on the
    observation's own batch number, not on its arrival.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()


def canonical(spark: SparkSession, store: str, key: str, order: str, keep_last: list[str], keep_max: list[str]) -> DataFrame:
    """Canonical records of everything the store holds."""
    return merge_scalars(spark.read.parquet(store), key, order, keep_last, keep_max)


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by window and kind, with a watermark that bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), kind, "n")
