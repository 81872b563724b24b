"""Live changes of artifacts: what their log leaves, who could read before and after, and which invocations were bound.

Stand-in: events as a log of changes to the artifact user_id; click renames, purchase sets the readers, signup sets the owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import last_before
from evigrid.plans.registry import query
from evigrid.sources.tables import table

#: Stand-in kinds of change by event type.
KINDS = {"click": "path", "purchase": "readers", "signup": "owner"}


def applied(log: DataFrame, fields: list[str]) -> DataFrame:
    """(artifact_id, one column for each field, generation) after a log (artifact_id, at, field, value): last values and the number of changes.

    The fold is an aggregate by the latest place in the log, so that a hot artifact's changes are combined before the shuffle.
    """
    latest = [F.max_by("value", F.when(F.col("field") == f, F.col("at"))).alias(f) for f in fields]
    return log.groupBy("artifact_id").agg(*latest, F.count_if(F.col("field").isin(fields)).alias("generation"))


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.lit(None).cast("string")
    for kind, name in KINDS.items():
        field = F.when(F.col("event_type") == kind, name).otherwise(field)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id"), F.struct("ts", "event_id").alias("at"), field.alias("field"), F.col("event_id").alias("value"))


_LAST = ", ".join(f"last(event_id ORDER BY ts, event_id) FILTER (event_type = '{kind}') AS {name}" for kind, name in KINDS.items())


@query(f"SELECT user_id AS artifact_id, {_LAST}, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS generation FROM events GROUP BY 1")
def mutated_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artifact after all changes, with its generation."""
    return applied(change_rows(spark, sf_dir), list(KINDS.values()))


@query("SELECT event_id, user_id AS artifact_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_access, value AS post_access FROM events WHERE event_type = 'purchase'")
def access_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of readers as an event that holds the access before and after it."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("artifact_id"), "ts", F.struct("value").alias("now"))
    rows = last_before(rows, ["artifact_id"], ["ts", "event_id"], F.col("now"), "was")
    return rows.select("event_id", "artifact_id", F.col("was.value").alias("prior_access"), F.col("now.value").alias("post_access"))


@query("SELECT o_orderkey AS publication, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1 AS accepted FROM orders")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is published once: the first publication stands and later ones of the same version are refused."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("publication"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    first = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("at").alias("first"))
    return o.join(first, ["o_custkey", "o_orderpriority"]).select("publication", (F.col("at") == F.col("first")).alias("accepted"))


@query("""WITH m AS (SELECT event_id AS call_id, user_id AS request_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM events)
SELECT call_id, request_id, CASE WHEN event_type = 'signup' THEN CASE WHEN mark = 'signup' THEN 'rebinding_refused' ELSE 'opened' END WHEN event_type = 'purchase' THEN CASE WHEN mark = 'signup' THEN 'released' ELSE 'not_open' END WHEN mark = 'signup' THEN 'allowed' ELSE 'denied' END AS verdict FROM m""")
def invocation_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open invocation a request: signup opens, purchase releases; opening twice is refused and calls without an open one are denied."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("request_id"), "ts", "event_type")
    rows = last_before(rows, ["request_id"], ["ts", "call_id"], F.when(kind.isin("signup", "purchase"), kind), "mark")
    bound = F.coalesce(F.col("mark") == "signup", F.lit(False))
    opens = F.when(bound, "rebinding_refused").otherwise("opened")
    releases = F.when(bound, "released").otherwise("not_open")
    verdict = F.when(kind == "signup", opens).when(kind == "purchase", releases).otherwise(F.when(bound, "allowed").otherwise("denied"))
    return rows.select("call_id", "request_id", verdict.alias("verdict"))
