"""Ids, seeded draws and hashes that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import numeric as N
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table


@query("SELECT doc_id, left(sha256('seed' || chr(31) || source || chr(31) || CAST(doc_id AS VARCHAR)), 10) AS opaque_id FROM documents")
def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("\u001f", F.lit("seed"), "source", F.col("doc_id").cast("string")).cast("binary"), 256), 1, 10).alias("opaque_id"))


_U = "CAST(('0x' || left(md5('3|' || CAST(event_id AS VARCHAR)), 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT event_id AS call_id, CASE WHEN {_U} < 0.15::DOUBLE THEN 'timeout' WHEN {_U} < 0.25::DOUBLE THEN 'error' WHEN {_U} < 0.45::DOUBLE THEN 'partial' ELSE 'ok' END AS outcome FROM events")
def failure_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic outcome of each call by cumulative rates."""
    u = N.uniform(F.lit(3), F.col("call_id"))
    return calls(spark, sf_dir).select("call_id", F.when(u < 0.15, "timeout").when(u < 0.25, "error").when(u < 0.45, "partial").otherwise("ok").alias("outcome"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0.5 END, CASE WHEN o_orderstatus = 'F' THEN 0.3 END, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.2 END, 0.1)::DOUBLE AS rate FROM orders")
def failure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific rule wins: source and tool, source, profile, default."""
    rules = spark.createDataFrame([("F", "1-URGENT", 0.5), ("F", None, 0.3), (None, "1-URGENT", 0.2)], "hub string, tool string, rate double")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("hub"), F.col("o_orderpriority").alias("tool"))
    both = rules.where("hub IS NOT NULL AND tool IS NOT NULL").withColumnRenamed("rate", "r1")
    hub = rules.where("tool IS NULL").select("hub", F.col("rate").alias("r2"))
    tool = rules.where("hub IS NULL").select("tool", F.col("rate").alias("r3"))
    j = o.join(F.broadcast(both), ["hub", "tool"], "left").join(F.broadcast(hub), "hub", "left").join(F.broadcast(tool), "tool", "left")
    return j.select("o_orderkey", F.coalesce("r1", "r2", "r3", F.lit(0.1)).alias("rate"))


@query("SELECT source, count(*) AS n, sum(CAST(('0x' || left(sha256(text), 8)) AS BIGINT))::BIGINT AS digest FROM documents GROUP BY source")
def content_hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of all texts: hashes are summed, so no order and no list of a source's texts is needed."""
    h = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


@query("SELECT p_partkey, 'Part ' || p_name || ' costs ' || CAST(p_size AS VARCHAR) || '.' AS text, 5 AS start, 5 + length(p_name) AS \"end\" FROM part")
def render_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled template and the exact place of a value in it."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(F.lit("Part "), "p_name", F.lit(" costs "), F.col("p_size").cast("string"), F.lit(".")).alias("text"), F.lit(5).alias("start"), (F.lit(5) + F.length("p_name")).cast("bigint").alias("end"))
