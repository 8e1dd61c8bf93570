"""Queries that run as streams over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.operators.lineage import shared_folder
from scholargraph.plans.corpus_queries import OBS_SQL
from scholargraph.plans.registry import query
from scholargraph.sources import tables as T
from scholargraph.streaming import ingest


@query(f"""WITH {OBS_SQL} SELECT ut, arg_max(value, batch) FILTER (WHERE value IS NOT NULL) AS value, arg_max(kind, batch) AS kind, max(reported) AS max_reported,
count(*) AS observations, min(batch) AS first_batch, max(batch) AS last_batch FROM obs GROUP BY 1""")
def streaming_canonical(spark, d) -> DataFrame:
    """The events arrive as a stream of files; the canonical records are those of the batch merge."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    obs = T.table(spark, d, "events").select(
        F.col("user_id").alias("ut"), F.col("event_id").alias("batch"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("reported"))
    obs.repartition(6, "batch").write.parquet(f"{folder}/arriving")
    run = ingest.ingest(ingest.observation_stream(spark, f"{folder}/arriving", obs.schema, 2), f"{folder}/store", f"{folder}/progress")
    run.awaitTermination()
    return ingest.canonical(spark, f"{folder}/store", "ut", "batch", ["value", "kind"], ["reported"])
