"""The change feed: numbered events, and each reader's own view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table


def numbered(events: DataFrame) -> DataFrame:
    """A strictly increasing number over all events."""
    return running(events, [], ["ts", "event_id"], F.lit(1), "seq")


_SEQ = "s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"


@query(f"WITH {_SEQ} SELECT seq, event_id, event_type AS kind, user_id AS subject FROM s")
def change_log_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events")).select(F.col("seq").cast("bigint").alias("seq"), "event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("subject"))


def reader_view(events: DataFrame) -> DataFrame:
    """What each reader is shown, densely numbered: filtered first, then counted."""
    shown = events.where("event_type <> 'error'").select(F.col("user_id").alias("reader"), "ts", "event_id", F.col("event_type").alias("kind"))
    return running(shown, ["reader"], ["ts", "event_id"], F.lit(1), "reader_seq").select("reader", "reader_seq", "event_id", "kind")


_VIEW = "v AS (SELECT user_id AS reader, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reader_seq, event_id, event_type AS kind FROM events WHERE event_type <> 'error')"


@query(f"WITH {_VIEW} SELECT * FROM v", name="reader_view")
def reader_view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader_view(table(spark, sf_dir, "events"))


@query(f"WITH {_VIEW} SELECT * FROM v WHERE reader_seq > 40")
def reader_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader_view(table(spark, sf_dir, "events")).where("reader_seq > 40")


@query("SELECT event_id AS call_id, user_id AS request_id, event_type AS tool, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS call_index FROM events")
def call_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).select("call_id", "request_id", F.col("source_id").alias("tool"), "ts")
    return running(rows, ["request_id", "tool"], ["ts", "call_id"], F.lit(1), "n").select("call_id", "request_id", "tool", (F.col("n") - 1).alias("call_index"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 15)")
def revocation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    revoked = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 15").select("user_id")
    return e.join(revoked, "user_id", "left_anti").select("event_id")


@query("SELECT event_id AS call_id, CASE WHEN value > 100 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome FROM events")
def late_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", F.when(F.col("latency") > 100, "timeout").otherwise(F.col("outcome")).alias("outcome"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def hourly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
