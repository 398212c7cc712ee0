"""Readers for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("conv_id", T.StringType()), T.StructField("observed_at", T.TimestampType()), T.StructField("idempotency_key", T.StringType()),
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("object_id", T.StringType()), T.StructField("rev_hash", T.StringType())]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as JSON lines with a fixed schema, so nothing is read twice to infer one."""
    return spark.read.schema(MANIFEST).json(path)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the head of a ledger: a system message cuts off what is before it, very long ones are disabled."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        "conv_id", F.col("turn").cast("int").alias("position"), "role", "text", F.sha2("text", 256).alias("rev_hash"),
        F.concat_ws(":", "conv_id", "turn").alias("rev_id"),
        F.when(F.col("role") == "system", "allBefore").when(F.length("text") > 1500, "true").alias("disabled"),
        F.lit(False).alias("is_comment"), F.lit("accepted").alias("lifecycle"))
