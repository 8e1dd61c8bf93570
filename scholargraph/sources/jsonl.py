"""Reviewed JSON lines: strict readers, and an overlay that is taken whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """Rows of a JSON-lines file (or folder). A line that is no object of the schema, a missing key and a key that
    stands twice are errors; blank lines are none."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.col("value"), F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    faults = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not an object of the schema").when(F.col(f"r.{key}").isNull(), f"no {key}")
    bad = rows.withColumn("fault", faults).filter("fault is not null").select("fault", F.substring("value", 1, 80).alias("head")).orderBy("head").first()
    if bad is not None:
        raise ValueError(f"{path}: {bad['fault']}: {bad['head']}")
    out = rows.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    twice = out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(key).first()
    if twice is not None:
        raise ValueError(f"{path}: {key} {twice[key]} stands {twice['n']} times")
    return out


def overlay(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str], key: str) -> dict[str, DataFrame] | None:
    """All the files, or None if none of them is there; if only some are, or the keys of the files differ, it is an
    error: half an audit is no audit."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    there = {n for n, p in paths.items() if fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))}
    if not there:
        return None
    if there != set(paths):
        raise ValueError(f"the audit lacks {', '.join(sorted(set(paths) - there))}")
    read = {n: read_jsonl(spark, p, schemas[n], key) for n, p in paths.items()}
    first, *others = read
    for n in others:
        odd = read[first].select(key).exceptAll(read[n].select(key)).unionAll(read[n].select(key).exceptAll(read[first].select(key))).orderBy(key).first()
        if odd is not None:
            raise ValueError(f"{first} and {n} differ in {key} {odd[key]}")
    return read
