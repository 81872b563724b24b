"""Versions of artifacts: what is current, what held at a time, what a reader may see of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import last_before
from evigrid.plans.registry import query
from evigrid.sources.tables import hub_rows, table, versioned_rows


def current(rows: DataFrame) -> DataFrame:
    """The highest revision of each artifact outside experiments; artifacts with experiments only have none."""
    kept = rows.where(F.col("environment").isNull() | (F.col("environment") == "prod"))
    others = [c for c in rows.columns if c != "artifact_id"]
    return kept.groupBy("artifact_id").agg(F.max_by(F.struct(*others), "revision").alias("r")).select("artifact_id", "r.*")  # partial maxima, no sort


def as_of(rows: DataFrame, key: str, at: str, moment, *values: str) -> DataFrame:
    """The latest row of each key at or before a moment; ties by the values, greatest first."""
    return rows.where(F.col(at) <= moment).groupBy(key).agg(F.max(F.struct(at, *values)).alias("r")).select(key, "r.*")


@query("SELECT conv_id AS artifact_id, max(turn) AS revision FROM conversations WHERE role = 'user' GROUP BY conv_id")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(versioned_rows(spark, sf_dir)).select("artifact_id", "revision")


@query("SELECT conv_id AS artifact_id, turn AS revision, role FROM conversations WHERE turn = 1")
def version_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned_rows(spark, sf_dir).where("revision = 1").select("artifact_id", "revision", "role")


@query("WITH c AS (SELECT conv_id, max(turn) AS revision FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id AS artifact_id, c.revision, string_agg(CAST(v.turn AS VARCHAR), ',' ORDER BY v.turn) AS versions FROM c JOIN conversations v USING (conv_id) GROUP BY ALL")
def artifact_with_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versioned_rows(spark, sf_dir).select("artifact_id", "revision", "environment")
    versions = rows.groupBy("artifact_id").agg(F.sort_array(F.collect_set("revision")).alias("v"))
    return current(rows).join(versions, "artifact_id").select("artifact_id", "revision", F.array_join(F.col("v").cast("array<string>"), ",").alias("versions"))


@query("WITH v AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) SELECT conv_id AS artifact_id, turn AS revision, was AS role_before, role AS role_after FROM v WHERE was IS NOT NULL AND was <> role")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versioned_rows(spark, sf_dir).select("artifact_id", "revision", "role")
    rows = last_before(rows, ["artifact_id"], ["revision"], F.struct("role"), "before")
    return rows.where("role <> before.role").select("artifact_id", "revision", F.col("before.role").alias("role_before"), F.col("role").alias("role_after"))


@query("SELECT DISTINCT source AS location FROM documents WHERE lang = 'de'")
def list_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub_rows(spark, sf_dir).where(F.arrays_overlap("acl", F.array(F.lit("de")))).select("location").where("location IS NOT NULL").distinct()


@query("SELECT conv_id AS artifact_id, count(*) AS versions FROM conversations WHERE length(text) > 200 GROUP BY conv_id")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by a property of any of their versions."""
    return versioned_rows(spark, sf_dir).where(F.length("text") > 200).groupBy("artifact_id").agg(F.count("*").alias("versions"))


@query("SELECT o_custkey AS fact, max(o_orderdate) AS since, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS value FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00' GROUP BY o_custkey")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.lit("1996-06-30 00:00:00").cast("timestamp_ntz")
    return as_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", moment, "o_orderkey").select(F.col("o_custkey").alias("fact"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("value"))


@query("SELECT o_custkey AS fact, arg_max(o_orderkey, (o_orderdate, CAST(o_orderstatus = 'F' AS INT), o_orderkey)) AS value FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def fact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for the environment goes before one for all of the same release."""
    own = (F.col("o_orderstatus") == "F").cast("int")
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("o_orderstatus").isin("F", "O"))
    return rows.groupBy(F.col("o_custkey").alias("fact")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", own, "o_orderkey")).alias("value"))


@query("SELECT conv_id AS artifact_id, CASE WHEN conv_id % 3 = 0 THEN 'unsupported_version' WHEN max(turn) >= 2 THEN 'ok' ELSE 'not_found' END AS status FROM conversations GROUP BY conv_id")
def capability_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version argument on a place that keeps no versions is an error, never the current row."""
    rows = versioned_rows(spark, sf_dir).groupBy("artifact_id").agg(F.max("revision").alias("last"))
    return rows.select("artifact_id", F.when(F.col("artifact_id") % 3 == 0, "unsupported_version").when(F.col("last") >= 2, "ok").otherwise("not_found").alias("status"))
