"""Several plans or interpretations of one request, merged: one outcome a source, and evidence that several interpretations found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table

UNAVAILABLE, DENIED = "required_source_unavailable", "required_source_denied"


def merged_outcomes(plans: DataFrame, observed: DataFrame) -> DataFrame:
    """(request, source, status, reasons, gap) of plans (request, source, ord, call, status, reasons, required) and what was observed (request, source, outcome, authoritative, fetch_gap).

    A plan that calls its source wins over those that do not; among plans of the winning kind the first one's status holds and the reasons are united. A called
    source takes its status from its outcome, a missing one being a timeout. A called authoritative source that failed, or some of whose evidence could not be
    read, is a gap; so is a required one that was denied, failed or is unsupported. ord tells a source's plans apart; a source without observation is not authoritative.
    """
    called = F.bool_or("call")
    of_kind = plans.withColumn("any", F.struct("ord", "status"))
    merged = of_kind.groupBy("request", "source").agg(
        called.alias("call"),
        F.bool_or("required").alias("required"),
        F.min(F.when(F.col("call"), F.col("any"))).alias("if_called"),
        F.min("any").alias("if_not"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("call"), F.col("reasons"))))).alias("called_reasons"),
        F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("all_reasons"),
    )  # sets of reasons: a few codes, however many plans
    rows = merged.join(observed, ["request", "source"], "left")
    outcome = F.coalesce("outcome", F.lit("timeout"))
    status = F.when(~F.col("call"), F.col("if_not.status")).when(outcome == "ok", "called").when(outcome == "timeout", "timeout").otherwise("error")
    reasons = F.when(F.col("call"), F.col("called_reasons")).otherwise(F.col("all_reasons"))
    rows = rows.select("request", "source", "call", "required", status.alias("status"), reasons.alias("reasons"), F.coalesce("authoritative", F.lit(False)).alias("authoritative"), F.coalesce("fetch_gap", F.lit(False)).alias("fetch_gap"))
    failed = F.col("status").isin("timeout", "error")
    gap = (
        F.when(F.col("call") & F.col("authoritative") & (failed | F.col("fetch_gap")), UNAVAILABLE)
        .when(F.col("required") & F.array_contains("reasons", DENIED), DENIED)
        .when(F.col("required") & (failed | (F.col("status") == "unsupported_for_mode") | F.col("fetch_gap")), UNAVAILABLE)
    )
    rows = rows.withColumn("gap", gap)
    named = F.when(F.col("gap") == UNAVAILABLE, F.array_union("reasons", F.array(F.lit(UNAVAILABLE)))).otherwise(F.col("reasons"))
    return rows.select("request", "source", "status", F.array_sort(named).alias("reasons"), "gap")


_PLANS = """pl AS (SELECT user_id AS request, event_type AS source, event_id AS ord, event_id % 3 <> 0 AS call, CASE WHEN event_id % 3 <> 0 THEN 'called' WHEN event_id % 2 = 0 THEN 'skipped' ELSE 'unsupported_for_mode' END AS status,
  CASE event_id % 7 WHEN 0 THEN ['must_consult'] WHEN 1 THEN ['required_source_denied'] WHEN 2 THEN ['not_selected', 'must_consult'] WHEN 3 THEN ['not_selected'] ELSE [] END AS reasons, event_id % 5 = 0 AS required, date_trunc('day', ts) AS day, value FROM events),
ob AS (SELECT request, source, day, CASE CAST(floor(sum(value)) AS BIGINT) % 4 WHEN 2 THEN 'timeout' WHEN 3 THEN 'error' ELSE 'ok' END AS outcome, source IN ('purchase', 'click') AS authoritative, count(*) % 3 = 0 AS fetch_gap FROM pl WHERE source <> 'view' GROUP BY ALL),
m AS (SELECT request, source, day, bool_or(call) AS call, bool_or(required) AS required, arg_min(status, ord) FILTER (call) AS s1, arg_min(status, ord) AS s0, list_distinct(coalesce(flatten(list(reasons) FILTER (call)), [])) AS r1, list_distinct(flatten(list(reasons))) AS r0 FROM pl GROUP BY ALL),
s AS (SELECT m.*, CASE WHEN NOT call THEN s0 WHEN coalesce(outcome, 'timeout') = 'ok' THEN 'called' WHEN coalesce(outcome, 'timeout') = 'timeout' THEN 'timeout' ELSE 'error' END AS status, CASE WHEN call THEN r1 ELSE r0 END AS reasons, coalesce(authoritative, false) AS authoritative, coalesce(fetch_gap, false) AS fetch_gap FROM m LEFT JOIN ob USING (request, source, day)),
g AS (SELECT *, CASE WHEN call AND authoritative AND (status IN ('timeout', 'error') OR fetch_gap) THEN 'required_source_unavailable' WHEN required AND list_contains(reasons, 'required_source_denied') THEN 'required_source_denied'
  WHEN required AND (status IN ('timeout', 'error', 'unsupported_for_mode') OR fetch_gap) THEN 'required_source_unavailable' END AS gap FROM s)"""


@query(f"WITH {_PLANS} SELECT request, CAST(day AS DATE) AS day, source, status, array_to_string(list_sort(list_distinct(CASE WHEN gap = 'required_source_unavailable' THEN list_append(reasons, gap) ELSE reasons END)), ',') AS reasons, gap FROM g")
def source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome for each source of a reader's day, from all its plans."""
    rows = calls(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("request", F.struct("request_id", "day"))
    i = F.col("call_id")
    reasons = F.when(i % 7 == 0, F.array(F.lit("must_consult"))).when(i % 7 == 1, F.array(F.lit(DENIED))).when(i % 7 == 2, F.array(F.lit("not_selected"), F.lit("must_consult"))).when(i % 7 == 3, F.array(F.lit("not_selected"))).otherwise(F.array().cast("array<string>"))
    plans = rows.select("request", F.col("source_id").alias("source"), i.alias("ord"), (i % 3 != 0).alias("call"), F.when(i % 3 != 0, "called").when(i % 2 == 0, "skipped").otherwise("unsupported_for_mode").alias("status"), reasons.alias("reasons"), (i % 5 == 0).alias("required"))
    # doubles are added in the order of calls: in another order a sum may fall below a whole number
    upto = F.sum("latency").over(Window.partitionBy("request", "source_id").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0))
    total = F.floor(F.max_by("upto", "call_id")) % 4
    observed = rows.where("source_id <> 'view'").withColumn("upto", upto).groupBy("request", F.col("source_id").alias("source")).agg(F.when(total == 2, "timeout").when(total == 3, "error").otherwise("ok").alias("outcome"), (F.count("*") % 3 == 0).alias("fetch_gap"))
    observed = observed.withColumn("authoritative", F.col("source").isin("purchase", "click"))
    out = merged_outcomes(plans, observed)
    return out.select(F.col("request.request_id").alias("request"), F.col("request.day").alias("day"), "source", "status", F.array_join("reasons", ",").alias("reasons"), "gap")


def found_by(hits: DataFrame, budget: int) -> DataFrame:
    """(request, place, source, artifact, version, interpretations) of hits (request, source, pos, artifact, version, interpretation).

    Each (source, artifact, version) is fetched once, in the order of sources and of their hits, until the budget is spent; it keeps all interpretations
    that found it, also those after that. Hits of one pos go by artifact and version; a null interpretation adds none.
    """
    keys = hits.groupBy("request", "source", "artifact", "version").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("interpretation")).alias("interpretations"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("source", "pos", "artifact", "version"))
    return keys.withColumn("place", place).where(F.col("place") <= budget).drop("pos")  # limited in each task before it is shuffled


#: Evidence that a request may fetch.
BUDGET = 60


@query(f"""SELECT request, row_number() OVER (PARTITION BY request ORDER BY source, pos, artifact, version) AS place, source, artifact, version, interpretations FROM (
  SELECT l_suppkey AS request, l_returnflag AS source, l_partkey AS artifact, l_linestatus AS version, min(l_orderkey * 10 + l_linenumber) AS pos, coalesce(array_to_string(list_sort(list_distinct(list(nullif(l_linenumber % 4, 0)) FILTER (l_linenumber % 4 > 0))), ','), '') AS interpretations FROM lineitem GROUP BY ALL) QUALIFY place <= {BUDGET}""")
def interpretations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each request (a supplier's lines) with the interpretations that found it, within the budget."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("request"), F.col("l_returnflag").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("artifact"), F.col("l_linestatus").alias("version"), F.nullif(F.col("l_linenumber") % 4, F.lit(0)).alias("interpretation"))
    return found_by(rows, BUDGET).select("request", F.col("place").cast("bigint").alias("place"), "source", "artifact", "version", F.array_join(F.col("interpretations").cast("array<string>"), ",").alias("interpretations"))
