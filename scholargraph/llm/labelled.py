"""Labelled rows for training: folds, bounded samples, and features gathered on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, columns: list[str]) -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold: those whose id has the smallest hash.

    Several labels of one document count as its largest. The sample of ids is bounded by `rows`, so it is broadcast;
    the documents are scanned once and never shuffled.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id").select("label", *columns)
