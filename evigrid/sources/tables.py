"""Test tables as the engine's relations: rows of hubs, versions, calls, facts, calibration records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the single versions of one hub: location is the source, the reader group is the language."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("source").alias("location"), F.array("lang").alias("acl"), "text")


def versioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as artifacts with revisions; assistants' turns are an experiment."""
    environment = F.when(F.col("role") == "user", "prod").otherwise("experiment")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("artifact_id"), F.col("turn").alias("revision"), environment.alias("environment"), "role", "text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observed calls of requests to sources."""
    outcome = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("request_id"), F.col("event_type").alias("source_id"), F.col("value").alias("latency"), outcome.alias("outcome"), "ts")


def calibration_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents as (case, grp, p_raw, label)."""
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / F.lit(1000.0)), 6)
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("case"), F.col("source").alias("grp"), p.alias("p_raw"), F.col("quality").cast("int").alias("label"))
