"""Sinks and declared inputs, each written from tables and read back: what comes out is what went in, by way of the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.plans.registry import query
from evigrid.sources import declared, runs
from evigrid.sources.files import append_changes, change_log
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import calls, table


@query("SELECT o_custkey AS case_id, max(o_totalprice) AS score, count(*) AS units FROM orders GROUP BY 1")
def run_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's scores, written with its manifest and read back by their schema."""
    folder = shared_folder(spark)
    scores = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_totalprice").alias("score"), F.count("*").alias("units"))
    runs.write_run(folder, "run-1", {"scores": scores}, {"arm": "rules"})
    return runs.read_run(spark, folder, "run-1", "scores", scores.schema)


@query("SELECT seq, hub, kind, subject FROM (SELECT row_number() OVER (PARTITION BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END ORDER BY event_id) + CASE WHEN event_type = 'view' THEN 0 ELSE (SELECT count(*) FROM events WHERE event_type = 'view') END AS seq, 'hub' AS hub, event_type AS kind, CAST(user_id AS VARCHAR) AS subject FROM events) WHERE seq > 50")
def log_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log with two appended parts, read after a cursor; the second part goes on with the first one's numbers."""
    log = shared_folder(spark)
    rows = calls(spark, sf_dir).select(F.lit("hub").alias("hub"), F.col("source_id").alias("kind"), F.col("request_id").cast("string").alias("subject"), F.lit(0).cast("bigint").alias("at_revision"), F.lit(False).alias("principal_scoped"), F.col("call_id").alias("at"))
    append_changes(log, rows.where("kind = 'view'"))
    append_changes(log, rows.where("kind <> 'view'"))
    return change_log(spark, log, 50).select("seq", "hub", "kind", "subject")


@query("SELECT conv_id AS request_id, turn AS round, role, sha256(text) AS text_hash, false AS leaked FROM conversations")
def stored_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exchanges with a credential in each, stored and read back: the credential is gone, the rest is whole."""
    folder = shared_folder(spark)
    body = F.to_json(F.struct("role", "text", F.struct(F.lit("Bearer x").alias("Authorization"), F.col("turn").alias("n")).alias("headers")))
    runs.store_exchanges(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("round"), body.alias("body")), folder)
    rows = spark.read.parquet(folder)
    field = lambda name: F.get_json_object("body", f"$.{name}")
    return rows.select("request_id", "round", field("role").alias("role"), F.sha2(field("text").cast("binary"), 256).alias("text_hash"), F.contains(F.lower("body"), F.lit("authorization")).alias("leaked"))


@query("SELECT c_custkey AS request_id, n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def canned_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with its canned response, null without one."""
    responses = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("request_id")).agg(F.count("*").alias("orders"))
    return runs.canned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id")), responses).select("request_id", "response.orders")


def _declared(rows: DataFrame, key: str, value: Column, folder: str) -> str:
    """One file a row, below the folder; the pattern that finds them. JSON is YAML, too."""
    rows.select(key, value.alias("value")).repartition(key).write.option("lineSep", "\n").partitionBy(key).text(folder)
    return f"{folder}/*/part-*"


@query("SELECT n_name AS principal, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS groups FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def declared_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principals (nations) and their groups (segments of their customers), declared a file each and read back."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.max("n_name").alias("n"), F.collect_set("c_mktsegment").alias("g"))
    pattern = _declared(rows, "n_nationkey", F.to_json(F.struct(F.create_map("n", "g").alias("principals"))), shared_folder(spark))
    return declared.principals(spark, pattern).select("principal", F.array_join("groups", ",").alias("groups"))


@query("SELECT 'q-' || item_id AS id, 'family-' || item_id % 4 AS family, CASE WHEN item_id % 3 = 0 THEN 1000 ELSE 4000 END AS budget_tokens, 3000 AS deadline_ms, sha256(text) AS text_hash, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS named, CASE WHEN item_id % 2 = 0 THEN 'svc-' || item_id END AS native FROM benchmark")
def declared_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question specs, a file each: half of them name a native name, the others entities; what a file leaves out takes its default."""
    i = F.col("item_id")
    name = F.when(i % 2 == 0, F.struct(F.concat(F.lit("svc-"), i.cast("string")).alias("native"), F.lit("hub").alias("hub")))
    spec = F.struct(F.concat(F.lit("q-"), i.cast("string")).alias("id"), F.concat(F.lit("family-"), (i % 4).cast("string")).alias("family"), F.col("text"), F.when(i % 2 == 1, F.array(F.lit("e1"))).alias("entities"), name.alias("name"), F.when(i % 3 == 0, 1000).alias("budget_tokens"))
    pattern = _declared(table(spark, sf_dir, "benchmark"), "item_id", F.to_json(spec), shared_folder(spark))
    return declared.questions(spark, pattern).select("id", "family", "budget_tokens", "deadline_ms", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.col("name").isNotNull().cast("int").alias("named"), "name.native")
