"""Scores of answers against what was expected: conflicts, ambiguity, honesty, labels, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.operators.scoring import _SPANS, required_spans
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table

_RELATIONS = """rel AS (SELECT l_orderkey AS request, l_linenumber AS relation_id, CASE WHEN l_returnflag = 'R' THEN 'version' ELSE 'contradiction' END AS expected, l_partkey % 3 = 0 AS a_kept, l_suppkey % 4 <> 0 AS b_kept,
  CASE WHEN l_quantity > 10 THEN CASE WHEN l_linestatus = 'F' THEN 'version' ELSE 'contradiction' END END AS flagged_as FROM lineitem)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as expected relations of a request: whether each witness was kept, and how the pair was flagged, if it was."""
    kind = F.when(F.col("l_returnflag") == "R", "version").otherwise("contradiction")
    flagged = F.when(F.col("l_quantity") > 10, F.when(F.col("l_linestatus") == "F", "version").otherwise("contradiction"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("relation_id"), kind.alias("expected"), (F.col("l_partkey") % 3 == 0).alias("a_kept"), (F.col("l_suppkey") % 4 != 0).alias("b_kept"), flagged.alias("flagged_as"))


@query(f"WITH {_RELATIONS} SELECT o_orderkey AS request, round(avg(CASE WHEN request IS NOT NULL THEN CAST(a_kept AND b_kept AND coalesce(flagged_as = expected, false) AS INT) END), 6) AS kept FROM orders LEFT JOIN rel ON request = o_orderkey GROUP BY 1")
def witnesses_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a request's expected relations with both witnesses kept and a flag of the right type; null where none is expected."""
    ok = F.col("a_kept") & F.col("b_kept") & F.coalesce(F.col("flagged_as") == F.col("expected"), F.lit(False))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"))
    share = _relations(spark, sf_dir).groupBy("request").agg(F.round(F.avg(ok.cast("int")), 6).alias("kept"))
    return requests.join(share, "request", "left").select("request", "kept")


@query(f"WITH {_RELATIONS} SELECT request, count(*) FILTER (flagged_as IS NOT NULL AND NOT (a_kept AND b_kept)) AS false_flags, round(avg(CAST(flagged_as = expected AS INT)) FILTER (a_kept AND b_kept), 6) AS type_accuracy FROM rel GROUP BY request")
def false_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pairs that witness no expected relation, and among those that do the share with the right type."""
    both = F.col("a_kept") & F.col("b_kept")
    return _relations(spark, sf_dir).groupBy("request").agg(F.count_if(F.col("flagged_as").isNotNull() & ~both).alias("false_flags"), F.round(F.avg(F.when(both, (F.col("flagged_as") == F.col("expected")).cast("int"))), 6).alias("type_accuracy"))


_INTERPRETED = """i AS (SELECT user_id AS request, list_sort(list(DISTINCT event_type)) AS got, ['separate', 'clarify', 'unique'][user_id % 3 + 1] AS policy, bool_or(value > 90) AS clarification, bool_or(value < 5) AS wrong_activation FROM events GROUP BY user_id)"""


def _interpreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as interpretations (event types) of a reader's request, with a policy for its ambiguity."""
    policy = F.element_at(F.array(*map(F.lit, ("separate", "clarify", "unique"))), (F.col("request_id") % 3 + 1).cast("int"))
    return calls(spark, sf_dir).groupBy(F.col("request_id").alias("request")).agg(F.sort_array(F.collect_set("source_id")).alias("got"), F.first(policy).alias("policy"), F.bool_or(F.col("latency") > 90).alias("clarification"), F.bool_or(F.col("latency") < 5).alias("wrong_activation"))


@query(f"""WITH {_INTERPRETED} SELECT request, CASE policy WHEN 'separate' THEN NOT (clarification AND len(got) = 0) AND got = ['click', 'error', 'purchase', 'signup', 'view'] AND NOT wrong_activation WHEN 'clarify' THEN clarification END AS handled,
  CASE WHEN policy = 'unique' THEN len(got) > 1 OR clarification END AS false_ambiguity FROM i""")
def ambiguity_handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate alternatives must be exactly the allowed ones without a wrong activation; a clarification must be asked for; a unique meaning must stay one."""
    allowed = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    handled = F.when(F.col("policy") == "separate", ~(F.col("clarification") & (F.size("got") == 0)) & (F.col("got") == allowed) & ~F.col("wrong_activation")).when(F.col("policy") == "clarify", F.col("clarification"))
    return _interpreted(spark, sf_dir).select("request", handled.alias("handled"), F.when(F.col("policy") == "unique", (F.size("got") > 1) | F.col("clarification")).alias("false_ambiguity"))


@query("SELECT event_id AS activation, event_type AS ref, 'entity' AS why FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') UNION ALL SELECT event_id, event_type, 'prohibited' FROM events WHERE event_type IN ('error')")
def wrong_entity_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations of an entity that isn't allowed, and of a prohibited reference; one can count twice."""
    rows = calls(spark, sf_dir).select(F.col("call_id").alias("activation"), F.col("source_id").alias("ref"), "request_id")
    allowed = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("request_id"))
    wrong = rows.join(allowed, "request_id", "left_anti").select("activation", "ref", F.lit("entity").alias("why"))
    return wrong.unionByName(rows.where("ref = 'error'").select("activation", "ref", F.lit("prohibited").alias("why")))


@query("""WITH f AS (SELECT user_id AS case_id, event_type AS source_id, bool_or(value > 70) AS failed, bool_or(value BETWEEN 60 AND 70) AS denied FROM events GROUP BY ALL HAVING failed OR denied),
rep AS (SELECT user_id AS case_id, event_type AS source_id, CASE WHEN count(*) % 4 = 0 THEN 'error' WHEN count(*) % 4 = 1 THEN 'called' END AS status, [['source_timeout'], ['routing_selected'], ['access_denied']][count(*) % 3 + 1] AS reasons FROM events GROUP BY ALL),
j AS (SELECT f.*, coalesce(status = 'error' OR (failed AND list_contains(reasons, 'source_timeout')) OR (denied AND NOT failed AND list_contains(reasons, 'access_denied')), false) AS reported FROM f LEFT JOIN (SELECT * FROM rep WHERE status IS NOT NULL) rep USING (case_id, source_id))
SELECT case_id, bool_or(failed AND source_id = 'purchase') AND case_id % 2 = 0 AS overclaimed, coalesce(string_agg(source_id, ',' ORDER BY source_id) FILTER (NOT reported), '') AS unreported, NOT (bool_or(failed AND source_id = 'purchase') AND case_id % 2 = 0) AND bool_and(reported) AS honest FROM j GROUP BY case_id""")
def case_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed mandatory source of an answer called sufficient is an overclaim; a failed source without a failure status or reason of its own is unreported."""
    rows = calls(spark, sf_dir).select(F.col("request_id").alias("case_id"), "source_id", "latency")
    by = rows.groupBy("case_id", "source_id").agg(F.bool_or(F.col("latency") > 70).alias("failed"), F.bool_or(F.col("latency").between(60, 70)).alias("denied"), F.count("*").alias("n"))
    status = F.when(F.col("n") % 4 == 0, "error").when(F.col("n") % 4 == 1, "called")
    reason = F.element_at(F.array(*map(F.lit, ("source_timeout", "routing_selected", "access_denied"))), (F.col("n") % 3 + 1).cast("int"))
    failure, denial = F.col("failed") & (F.col("reason") == "source_timeout"), F.col("denied") & ~F.col("failed") & (F.col("reason") == "access_denied")
    rows = by.where("failed OR denied").withColumns({"status": status, "reason": reason})
    rows = rows.withColumn("reported", F.col("status").isNotNull() & ((F.col("status") == "error") | failure | denial))
    over = F.bool_or(F.col("failed") & (F.col("source_id") == "purchase")) & (F.col("case_id") % 2 == 0)
    lost = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("reported"), F.col("source_id")))), ",")
    return rows.groupBy("case_id").agg(over.alias("overclaimed"), lost.alias("unreported"), (~over & F.bool_and("reported")).alias("honest"))


@query("SELECT l.doc_id AS case_id, coalesce(d.n_chars, 0) AS used, CASE WHEN d.doc_id IS NULL THEN 'timeout' ELSE 'answered' END AS outcome, d.doc_id IS NOT NULL AND l.quality > 0 AS success FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars > 1000")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case without an answer gets a row of a failed case: nothing used, no success."""
    answers = table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", "n_chars", F.lit("answered").alias("outcome"))
    rows = table(spark, sf_dir, "labels").join(answers, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("case_id"), F.coalesce("n_chars", F.lit(0)).alias("used"), F.coalesce("outcome", F.lit("timeout")).alias("outcome"), (F.col("outcome").isNotNull() & (F.col("quality") > 0)).alias("success"))


@query(f"WITH {_SPANS}, s AS (SELECT DISTINCT item_id, source FROM sp), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id) SELECT source, round((SELECT count(*) FROM n) * 1.0 / (SELECT count(*) FROM benchmark), 6) AS recall, round((SELECT count(*) FROM n) * 1.0 / (SELECT count(*) FROM benchmark) - count(*) FILTER (n = 1) * 1.0 / (SELECT count(*) FROM benchmark), 6) AS without, count(*) FILTER (n = 1) > 0 AS useful FROM s JOIN n USING (item_id) GROUP BY source")
def useful_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is useful when recall falls without it. Items that it alone holds decide, so no run is repeated."""
    held = required_spans(spark, sf_dir).select("item_id", "source").distinct()
    n = held.groupBy("item_id").agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("total")).crossJoin(n.agg(F.count("*").alias("found")))
    lost = held.join(n, "item_id").groupBy("source").agg(F.count_if(F.col("n") == 1).alias("lost")).crossJoin(F.broadcast(total))
    recall = F.col("found") / F.col("total")
    return lost.select("source", F.round(recall, 6).alias("recall"), F.round(recall - F.col("lost") / F.col("total"), 6).alias("without"), (F.col("lost") > 0).alias("useful"))


@query("WITH r AS (SELECT event_type, user_id % 5 AS size, value, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS n FROM events) SELECT event_type AS provider, size, round(quantile_cont(value, 0.5), 6) AS median_ms, count(*) AS repeats FROM r WHERE n > 1 GROUP BY ALL")
def batch_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the warm repeats of each provider and batch size; the first call of each is cold."""
    rows = calls(spark, sf_dir).select(F.col("source_id").alias("provider"), (F.col("request_id") % 5).alias("size"), "ts", "call_id", "latency")
    cold = rows.groupBy("provider", "size").agg(F.min_by("call_id", F.struct("ts", "call_id")).alias("cold"))
    warm = rows.join(F.broadcast(cold), ["provider", "size"]).where("call_id <> cold")  # a row for each provider and size
    return warm.groupBy("provider", "size").agg(F.round(F.percentile("latency", F.lit(0.5)), 6).alias("median_ms"), F.count("*").alias("repeats"))


@query("SELECT d.doc_id AS request, d.source, l.quality, p.page_id IS NOT NULL AS traced FROM documents d JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id")
def run_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their expectation; answers without one are dropped, traces may be missing."""
    gold, traces = table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("traced"))
    return table(spark, sf_dir, "documents").join(gold, "doc_id").join(traces, "doc_id", "left").select(F.col("doc_id").alias("request"), "source", "quality", F.coalesce("traced", F.lit(False)).alias("traced"))


@query("""WITH r AS (SELECT doc_id AS request, 1 AS run, n_chars > 2000 AS scored, lang AS first FROM documents UNION ALL SELECT doc_id, 2, doc_id % 3 <> 0, source FROM documents UNION ALL SELECT doc_id, 3, true, lang FROM documents WHERE doc_id % 5 = 0)
SELECT request, arg_min(run, CAST(NOT scored AS INT) * 10 + run) AS run, bool_or(scored) AS scored, count(DISTINCT first) > 1 AS differs FROM r GROUP BY request""")
def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several runs of a request the first one with scores counts; whether their orders differ is told."""
    d = table(spark, sf_dir, "documents")
    runs = d.select(F.col("doc_id").alias("request"), F.lit(1).alias("run"), (F.col("n_chars") > 2000).alias("scored"), F.col("lang").alias("first"))
    runs = runs.unionByName(d.select(F.col("doc_id").alias("request"), F.lit(2).alias("run"), (F.col("doc_id") % 3 != 0).alias("scored"), F.col("source").alias("first")))
    runs = runs.unionByName(d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("request"), F.lit(3).alias("run"), F.lit(True).alias("scored"), F.col("lang").alias("first")))
    return runs.groupBy("request").agg(F.min_by("run", F.struct(~F.col("scored"), "run")).alias("run"), F.bool_or("scored").alias("scored"), (F.min("first") != F.max("first")).alias("differs"))


_EXPECTED = "['click', 'view']"


@query(f"""WITH s AS (SELECT user_id AS request, list_sort(list(DISTINCT event_type)) AS got FROM events GROUP BY user_id) SELECT request, array_to_string(list_sort(list_intersect(got, {_EXPECTED})), ',') AS shared, array_to_string(list_sort(list_filter(got, lambda x: NOT list_contains({_EXPECTED}, x))), ',') AS more,
  len(list_filter({_EXPECTED}, lambda x: NOT list_contains(got, x))) = 0 AS required, got = {_EXPECTED} AS same FROM s""")
def reason_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons given against those required: what both have, what is more, whether all required ones are there, whether they are the same."""
    want, got = F.array(F.lit("click"), F.lit("view")), F.col("got")
    rows = calls(spark, sf_dir).groupBy(F.col("request_id").alias("request")).agg(F.sort_array(F.collect_set("source_id")).alias("got"))
    return rows.select("request", F.array_join(F.array_intersect(got, want), ",").alias("shared"), F.array_join(F.array_except(got, want), ",").alias("more"), (F.size(F.array_except(want, got)) == 0).alias("required"), (got == want).alias("same"))


@query("""WITH c AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS a, CASE WHEN n_nationkey % 4 = 0 THEN 'none' WHEN n_nationkey % 7 = 0 THEN '9' ELSE CAST(n_regionkey AS VARCHAR) END AS b, r_name AS switch FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT key, 'recorded ' || key || ' differs between runs' AS problem FROM c WHERE a IS DISTINCT FROM b AND NOT (switch IN ('ASIA', 'EUROPE') AND (a = 'none' OR b = 'none'))""")
def effective_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded inputs that differ between two runs; those of a switch that may differ are exempt only where it is off in one of them."""
    c = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    a = F.col("n_regionkey").cast("string")
    c = c.select(F.col("n_name").alias("key"), a.alias("a"), F.when(F.col("n_nationkey") % 4 == 0, "none").when(F.col("n_nationkey") % 7 == 0, "9").otherwise(a).alias("b"), F.col("r_name").alias("switch"))
    exempt = F.col("switch").isin("ASIA", "EUROPE") & ((F.col("a") == "none") | (F.col("b") == "none"))
    return c.where(~F.col("a").eqNullSafe(F.col("b")) & ~exempt).select("key", F.concat(F.lit("recorded "), "key", F.lit(" differs between runs")).alias("problem"))


@query(f"WITH {_SPANS} SELECT d.doc_id, CAST(coalesce(bool_or(sp.s < d.n_chars // 2 AND 0 < sp.e), false) AS INT) AS label FROM documents d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit, the first half of a document, is labelled 1 when it overlaps a required span."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 2").alias("ue"))
    hit = required_spans(spark, sf_dir).join(units, "doc_id").where("start < ue AND 0 < end").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return units.join(hit, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(0)).alias("label"))


@query("SELECT conv_id AS receipt, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line FROM conversations")
def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each entry of a receipt, for links to it."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("receipt"), "turn", "role", "text")
    return running(rows, ["receipt"], ["turn", "role", "text"], F.lit(1), "line").select("receipt", "turn", F.col("line").cast("bigint").alias("line"))


@query("SELECT doc_id AS case_id, CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN CAST(quality > 0 AS DOUBLE) WHEN doc_id % 4 = 1 THEN CAST(quality AS DOUBLE) ELSE CAST(toxic > 0 AS DOUBLE) END AS value FROM labels")
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as numbers: truth as 1 and 0, numbers as they are, a list as 1 where it holds anything, null as null."""
    listed = F.when(F.col("toxic") > 0, F.array(F.lit("gate"))).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("quality").isNull(), None).when(F.col("doc_id") % 4 == 0, (F.col("quality") > 0).cast("double")).when(F.col("doc_id") % 4 == 1, F.col("quality").cast("double")).otherwise((F.size(listed) > 0).cast("double"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), value.alias("value"))
