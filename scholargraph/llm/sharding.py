"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed

ROW_OVERHEAD = 16


def assign_shards(docs: DataFrame, n_shards: int = 40, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Cuts the documents, ordered by doc_id, into `n_shards` contiguous shards of nearly equal bytes.

    Rows are dealt into ordered ranges; each range reports one total; the running sum of those totals (one row a
    range) plus a running sum inside each range is the global prefix sum. A row belongs to the shard in whose
    equal target its first byte falls, so shards differ by at most one document.

    Result: doc_id, size (UTF-8 bytes plus `overhead`), text_crc32, shard, slot (gapless from 0 in each shard).
    Null text counts as empty (crc32 0). Null doc_id sorts first. Repeated rows each get a slot of their own; ties
    in doc_id are ordered by crc32, then size; rows equal in all three are interchangeable. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["doc_id", "text_crc32", "size"]
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # The block number must not change between the two reads below, so the narrow table is materialised once.
    ranged = checkpointed(sized.repartitionByRange(blocks, *key).withColumn("block", F.spark_partition_id()))

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a range: bounded by the number of ranges, not by the input.
    offsets = (
        ranged.groupBy("block")
        .agg(F.sum("size").alias("block_bytes"), F.count(F.lit(1)).alias("block_rows"))
        .select(
            "block",
            F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("block_bytes").over(everything).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("block").orderBy(*key)
    placed = (
        ranged.withColumn("run", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "block")
        .select(
            *key,
            F.expr(f"cast(least({n_shards - 1}, ((bytes_before + run) * {n_shards}) div all_bytes) as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
