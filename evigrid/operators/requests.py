"""Requests and what serves them: bounds, projections, budgets of calls and questions, provider answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.operators.search import _CTE, _scored
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, hub_rows, table

#: Hits of a search without a stated number.
DEFAULT_K = 10
#: From which coverage on a unit is relevant, and takes part in conflicts.
RELEVANT, CONFLICTING = 0.4, 0.3
#: Calls of a request, at most; units that a model judges, at most.
CALLS, UNITS = 8, 12
#: Quantile of the normal distribution at 95 %.
Z95 = 1.6448536269514722


def top_k(requested: Column, most: int) -> Column:
    """The number of hits asked for, the default for none, null where it is outside 1 to most."""
    k = F.coalesce(requested, F.lit(DEFAULT_K))
    return F.when(k.between(1, most), k)


@query("SELECT n_nationkey AS request, CASE WHEN coalesce(CASE WHEN n_regionkey <> 2 THEN n_nationkey END, 10) BETWEEN 1 AND 20 THEN coalesce(CASE WHEN n_regionkey <> 2 THEN n_nationkey END, 10) END AS k FROM nation")
def top_k_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as requests, one in five of which names no number."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request"), top_k(F.when(F.col("n_regionkey") != 2, F.col("n_nationkey")), 20).alias("k"))


@query("SELECT source AS location, min(doc_id) FILTER (lang = 'fr') AS artifact_id FROM documents GROUP BY source")
def first_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first id of each place that the reader may see; null where there is none."""
    seen = F.arrays_overlap("acl", F.array(F.lit("fr")))
    return hub_rows(spark, sf_dir).groupBy("location").agg(F.min(F.when(seen, F.col("artifact_id"))).alias("artifact_id"))


@query("SELECT doc_id AS artifact_id, source AS location, sha256(text) AS text_hash FROM documents")
def public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves the hub of an artifact: never who may read it. Any other set of columns is refused."""
    rows = hub_rows(spark, sf_dir).drop("acl")
    if set(rows.columns) != {"artifact_id", "location", "text"}:
        raise ValueError(f"{rows.columns} are not the public columns")
    return rows.select("artifact_id", "location", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query(f"WITH {_CTE} SELECT artifact_id, coverage >= {RELEVANT} AS relevant, coverage >= {CONFLICTING} AS conflicting FROM s")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("artifact_id", (F.col("coverage") >= RELEVANT).alias("relevant"), (F.col("coverage") >= CONFLICTING).alias("conflicting"))


@query("WITH r AS (SELECT doc_id AS wanted FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 7 = 0) SELECT wanted, d.source AS location, CASE WHEN d.doc_id IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM r LEFT JOIN documents d ON d.doc_id = wanted AND d.lang IN ('en', 'fr')")
def deny_equals_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader cannot tell an artifact that is hidden from one that is not there."""
    labels = table(spark, sf_dir, "labels")
    wanted = labels.select(F.col("doc_id").alias("wanted")).unionByName(labels.where("doc_id % 7 = 0").select((F.col("doc_id") + 1000000000).alias("wanted")))
    seen = hub_rows(spark, sf_dir).where(F.arrays_overlap("acl", F.array(F.lit("en"), F.lit("fr")))).select(F.col("artifact_id").alias("wanted"), "location")
    return wanted.join(seen, "wanted", "left").select("wanted", "location", F.when(F.col("location").isNull(), "not_found").otherwise("ok").alias("status"))


@query("SELECT event_id AS call_id, ['exchange', 'passthrough', 'none'][event_id % 3 + 1] AS mode, event_id % 3 = 0 AND user_id % 11 <> 0 AS audience_valid FROM events")
def audience_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only an exchanged token is meant for the hub that gets it."""
    mode = F.element_at(F.array(*map(F.lit, ("exchange", "passthrough", "none"))), (F.col("call_id") % 3 + 1).cast("int"))
    rows = calls(spark, sf_dir).withColumn("mode", mode)
    return rows.select("call_id", "mode", ((F.col("mode") == "exchange") & (F.col("request_id") % 11 != 0)).alias("audience_valid"))


#: Options that a caller may not pass on.
PROTECTED = ("--seed", "--cases", "--include-held-back")


@query("SELECT DISTINCT n_name AS option, '--' || lower(left(n_name, 2)) AS given, '--' || lower(left(n_name, 2)) IN ('--s', '--se', '--see', '--c', '--ca', '--in', '--inc') AS refused FROM nation")
def protected_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given option is refused when a protected one begins with it: abbreviations would reach it too."""
    given = F.concat(F.lit("--"), F.lower(F.substring("n_name", 1, 2)))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("option"), given.alias("given"))
    refused = F.exists(F.array(*map(F.lit, PROTECTED)), lambda p: p.startswith(F.element_at(F.split("given", "="), 1)))
    return rows.select("option", "given", refused.alias("refused")).distinct()


@query("SELECT n_nationkey AS entity, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) OR n_regionkey = 2 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS visible FROM nation")
def reviewed_name_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed name shows when a place of it is readable, its namespace is at home, or an artifact about it is readable."""
    n = table(spark, sf_dir, "nation")
    place = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    artifact = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    seen = place.unionByName(n.where("n_regionkey = 2").select("n_nationkey")).unionByName(artifact).distinct().withColumn("seen", F.lit(True))
    return n.join(seen, "n_nationkey", "left").select(F.col("n_nationkey").alias("entity"), F.coalesce("seen", F.lit(False)).alias("visible"))


_VALUES = "v AS (SELECT o_custkey AS entity, o_orderpriority AS attribute, o_orderkey AS unit, CASE o_orderstatus WHEN 'F' THEN 'implemented' WHEN 'O' THEN 'procedure' ELSE 'policy' END AS kind, CAST(o_totalprice AS BIGINT) // 50000 AS value FROM orders)"


@query(f"WITH {_VALUES} SELECT a.entity, a.attribute, b.kind, min(a.unit) AS implemented, min(b.unit) AS witness, count(*) AS pairs FROM v a JOIN v b ON a.entity = b.entity AND a.attribute = b.attribute AND a.value <> b.value WHERE a.kind = 'implemented' AND b.kind <> 'implemented' GROUP BY ALL")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is implemented against procedures and policies of the same entity and attribute with another value; the first unit of each side is the witness."""
    kind = F.when(F.col("o_orderstatus") == "F", "implemented").when(F.col("o_orderstatus") == "O", "procedure").otherwise("policy")
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("attribute"), F.col("o_orderkey").alias("unit"), kind.alias("kind"), F.expr("cast(rint(o_totalprice) as bigint) div 50000").alias("value"))  # rounded, as the SQL's cast does: Spark's own cuts off
    # few values each: counted before they meet
    by = v.groupBy("entity", "attribute", "kind", "value").agg(F.min("unit").alias("unit"), F.count("*").alias("n"))
    a = by.where("kind = 'implemented'").select("entity", "attribute", F.col("value").alias("own"), F.col("unit").alias("implemented"), F.col("n").alias("m"))
    pairs = by.where("kind <> 'implemented'").join(a, ["entity", "attribute"]).where("value <> own")
    return pairs.groupBy("entity", "attribute", "kind").agg(F.min("implemented").alias("implemented"), F.min("unit").alias("witness"), F.sum(F.col("n") * F.col("m")).alias("pairs"))


@query("SELECT user_id AS request, array_to_string(list_sort(list_distinct(list(CASE event_type WHEN 'click' THEN 'visit' WHEN 'view' THEN 'visit' ELSE event_type END))), ',') AS refs FROM events GROUP BY user_id")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids replaced by the references they are aligned with; ids without one pass through."""
    alignment = F.create_map(*map(F.lit, ("click", "visit", "view", "visit")))
    rows = calls(spark, sf_dir).groupBy(F.col("request_id").alias("request")).agg(F.collect_set("source_id").alias("ids"))
    return rows.select("request", F.array_join(F.array_sort(F.array_distinct(F.transform("ids", lambda i: F.coalesce(F.try_element_at(alignment, i), i)))), ",").alias("refs"))


@query("WITH v AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ord, text FROM conversations) SELECT a.conv_id AS artifact_id, a.ord, sha256(coalesce(CASE WHEN a.conv_id % 10 = 0 THEN b.text ELSE a.text END, '')) AS text_hash FROM v a LEFT JOIN v b ON b.conv_id = a.conv_id + 1 AND b.ord = a.ord WHERE a.conv_id % 10 <> 0 OR b.ord IS NOT NULL")
def copied_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a copy take the texts of its source's versions, by position; versions beyond those fall away."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    v = running(rows, ["conv_id"], ["turn", "role", "text"], F.lit(1), "ord").select(F.col("conv_id").alias("artifact_id"), F.col("ord").cast("bigint").alias("ord"), "text")
    copies = v.where("artifact_id % 10 = 0").select("artifact_id", (F.col("artifact_id") + 1).alias("copy_of"), "ord")
    texts = copies.join(v.select(F.col("artifact_id").alias("copy_of"), "ord", "text"), ["copy_of", "ord"]).select("artifact_id", "ord", "text")
    both = v.where("artifact_id % 10 <> 0").unionByName(texts)
    return both.select("artifact_id", "ord", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_hash"))


@query("SELECT n_name AS hub, r_name AS family, n_nationkey % 2 = 0 AS version_reads, n_regionkey = 4 AS held_back FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 4")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs with their configuration; held-back ones are left out unless asked for. Both sides must agree on which they are."""
    n, r = table(spark, sf_dir, "nation").withColumn("held_back", F.col("n_regionkey") == 4), table(spark, sf_dir, "region").withColumn("configured", F.col("r_regionkey") == 4)
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    agreed = F.when(F.col("held_back") == F.col("configured"), F.col("held_back")).otherwise(F.raise_error(F.lit("held-back hubs differ")).cast("boolean"))
    return rows.select(F.col("n_name").alias("hub"), F.col("r_name").alias("family"), (F.col("n_nationkey") % 2 == 0).alias("version_reads"), agreed.alias("held_back")).where("NOT held_back")


def model_score(answer: Column) -> Column:
    """The calibrated probability of a receipt's answer (JSON), else the raw one, else the expected level."""
    return F.coalesce(*(F.get_json_object(answer, f"$.{f}").cast("double") for f in ("p", "raw", "expected.level")))


_ANSWERS = """a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"p": 0.' || (doc_id % 89 + 10) || ', "raw": 0.5}' WHEN 1 THEN '{"p": null, "raw": 0.' || (doc_id % 79 + 10) || '}' WHEN 2 THEN '{"expected": {"level": ' || (doc_id % 4) || '}}' WHEN 3 THEN '{}' ELSE 'no answer {' END AS answer FROM labels)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 5 == 0, F.concat(F.lit('{"p": 0.'), d % 89 + 10, F.lit(', "raw": 0.5}'))).when(d % 5 == 1, F.concat(F.lit('{"p": null, "raw": 0.'), d % 79 + 10, F.lit("}")))
    text = text.when(d % 5 == 2, F.concat(F.lit('{"expected": {"level": '), d % 4, F.lit("}}"))).when(d % 5 == 3, "{}").otherwise("no answer {")
    return table(spark, sf_dir, "labels").select("doc_id", text.alias("answer"))


@query(f"""WITH {_ANSWERS} SELECT doc_id AS receipt, CASE WHEN json_valid(answer) THEN coalesce(CAST(answer ->> '$.p' AS DOUBLE), CAST(answer ->> '$.raw' AS DOUBLE), CAST(answer ->> '$.expected.level' AS DOUBLE)) END AS score FROM a""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of receipts; one that is no JSON has none."""
    return _answers(spark, sf_dir).select(F.col("doc_id").alias("receipt"), model_score(F.col("answer")).alias("score"))


@query(f"""WITH {_ANSWERS} SELECT doc_id AS receipt, json_valid(answer) AS parsed, CASE WHEN json_valid(answer) THEN coalesce(CAST(answer ->> '$.p' AS DOUBLE) BETWEEN 0 AND 1, false) OR coalesce(CAST(answer ->> '$.expected.level' AS DOUBLE) BETWEEN 0 AND 2, false) ELSE false END AS valid FROM a""")
def valid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer counts when it is JSON and holds a probability, or a level inside the three that were declared."""
    parsed = F.try_parse_json("answer").isNotNull()
    p, level = (F.get_json_object("answer", f"$.{f}").cast("double") for f in ("p", "expected.level"))
    valid = F.coalesce(p.between(0, 1), F.lit(False)) | F.coalesce(level.between(0, 2), F.lit(False))
    return _answers(spark, sf_dir).select(F.col("doc_id").alias("receipt"), parsed.alias("parsed"), (parsed & valid).alias("valid"))


@query("SELECT user_id AS question, abs(sum(share) - 1) <= 0.01 AS adds_up, max(share) <= 0.6 AS even FROM (SELECT user_id, v / greatest(sum(v) OVER (PARTITION BY user_id), 1e-9) * CASE WHEN user_id % 3 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS share FROM (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL)) GROUP BY user_id")
def choice_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the choices of a question must add up to 1 within 0.01."""
    rows = calls(spark, sf_dir).groupBy(F.col("request_id").alias("question"), "source_id").agg(F.sum("latency").alias("v"))
    total = rows.groupBy("question").agg(F.greatest(F.sum("v"), F.lit(1e-9)).alias("t"))
    share = F.col("v") / F.col("t") * F.when(F.col("question") % 3 == 0, 0.9).otherwise(1.0)
    return rows.join(total, "question").groupBy("question").agg((F.abs(F.sum(share) - 1) <= 0.01).alias("adds_up"), (F.max(share) <= 0.6).alias("even"))


@query("""WITH u AS (SELECT doc_id, coalesce(n_chars % 3 = 0, false) AS truncated, n_chars % 100 AS dropped FROM documents) SELECT doc_id AS response, truncated OR (doc_id % 2 = 0 AND dropped > 90) AS state, CASE WHEN doc_id % 4 = 0 THEN 'q' || (doc_id % 5) ELSE '' END AS questions FROM u""")
def truncated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a provider says that it cut the state, and the questions that it cut; what it doesn't say counts as no."""
    usage = F.struct((F.col("n_chars") % 3 == 0).alias("truncated"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") % 100).alias("state_tokens_dropped"), F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("q"), F.col("doc_id") % 5))).alias("truncated_questions"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response"), usage.alias("usage"))
    state = F.coalesce("usage.truncated", F.lit(False)) | F.coalesce(F.col("usage.state_tokens_dropped") > 90, F.lit(False))
    return rows.select("response", state.alias("state"), F.coalesce(F.array_join("usage.truncated_questions", ","), F.lit("")).alias("questions"))


@query("SELECT doc_id, length(text) // 3 + 64 AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cautious reservation: three characters a token and 64 more."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr("char_length(text) div 3 + 64").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a text by the tokenizer that is declared with every count: words and single signs."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("bigint").alias("tokens"))


@query(f"SELECT event_type AS source_id, event_id AS call_id, round(40 * exp(ln(6.25) / {Z95} * ((value - 50) / 25)), 6) AS latency_ms FROM events")
def drawn_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lognormal latencies from a median of 40 and a 95th percentile of 250 ms and a standard normal draw for each call."""
    z = (F.col("latency") - 50) / 25
    return calls(spark, sf_dir).select("source_id", "call_id", F.round(F.lit(40) * F.exp(F.log(F.lit(250 / 40)) / Z95 * z), 6).alias("latency_ms"))


_PLANS = f"""pl AS (SELECT o_custkey AS request, o_orderkey AS plan, o_orderkey % 5 = 0 AS required, CAST(o_orderkey % 3 + 1 AS BIGINT) AS calls FROM orders)"""


def trimmed_plans(plans: DataFrame, most: int) -> DataFrame:
    """(request, plan, called): the last optional plan goes until a request's calls are at most `most`; required ones stay.

    An optional plan stays when it, the optional ones before it and all required ones fit: a sum over ranges, not a loop.
    """
    rows = running(plans, ["request"], ["plan"], F.when(F.col("required"), 0).otherwise(F.col("calls")), "optional")
    needed = plans.groupBy("request").agg(F.sum(F.when(F.col("required"), F.col("calls")).otherwise(0)).alias("needed"))
    return rows.join(needed, "request").select("request", "plan", (F.col("required") | (F.col("optional") + F.col("needed") <= most)).alias("called"))


@query(f"WITH {_PLANS} SELECT request, plan, required OR sum(CASE WHEN required THEN 0 ELSE calls END) OVER (PARTITION BY request ORDER BY plan) + sum(CASE WHEN required THEN calls ELSE 0 END) OVER (PARTITION BY request) <= {CALLS} AS called FROM pl")
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return trimmed_plans(o.select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("plan"), (F.col("o_orderkey") % 5 == 0).alias("required"), (F.col("o_orderkey") % 3 + 1).cast("bigint").alias("calls")), CALLS)


_CHOICES = "c AS (SELECT user_id AS request, event_type AS source_id, round(avg(value) / 100, 6) AS p, event_type = 'purchase' AND user_id % 3 = 0 AS required FROM events GROUP BY ALL), k AS (SELECT *, p >= 0.55 AS keep, bool_or(required OR p >= 0.55) OVER (PARTITION BY request) AS any_, bool_and(user_id_ok) OVER (PARTITION BY request) AS answered FROM (SELECT *, request % 13 <> 0 AS user_id_ok FROM c))"


@query(f"WITH {_CHOICES} SELECT request, source_id, NOT answered OR required OR keep OR (NOT any_ AND row_number() OVER (PARTITION BY request ORDER BY p DESC, source_id) <= 2) AS called FROM k")
def useful_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional sources that are confidently not useful are skipped, but for the two most likely where none would be left; a layer that did not answer skips nothing."""
    rows = calls(spark, sf_dir).groupBy(F.col("request_id").alias("request"), "source_id").agg(F.round(F.avg("latency") / 100, 6).alias("p"))
    rows = rows.withColumns({"required": (F.col("source_id") == "purchase") & (F.col("request") % 3 == 0), "answered": F.col("request") % 13 != 0})
    mine = Window.partitionBy("request")  # a row for each source
    left = F.bool_or(F.col("required") | (F.col("p") >= 0.55)).over(mine)
    likely = F.row_number().over(mine.orderBy(F.desc("p"), "source_id")) <= 2
    return rows.select("request", "source_id", (~F.col("answered") | F.col("required") | (F.col("p") >= 0.55) | (~left & likely)).alias("called"))


@query(f"WITH u AS (SELECT o_custkey AS request, o_orderkey AS unit, o_orderstatus <> 'F' AS excluded, row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), c AS (SELECT request, count(*) FILTER (excluded) AS e, count(*) FILTER (NOT excluded) AS r FROM u GROUP BY request) SELECT request, unit, excluded FROM u JOIN c USING (request) WHERE CASE WHEN excluded THEN n <= {UNITS} - least(r, {UNITS} - least({UNITS // 2}, e)) ELSE n <= {UNITS} - least({UNITS // 2}, e) END")
def judged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a model judges: up to half of them such as the rules exclude, and as many more as ranked ones leave room for."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") != "F").alias("excluded"), "o_totalprice")
    n = F.row_number().over(Window.partitionBy("request", "excluded").orderBy(F.desc("o_totalprice"), "unit"))
    c = o.groupBy("request").agg(F.count_if("excluded").alias("e"), F.count_if(~F.col("excluded")).alias("r"))
    first = o.withColumn("n", n).where(F.col("n") <= UNITS).join(c, "request")
    ranked = UNITS - F.least(F.lit(UNITS // 2), "e")
    return first.where(F.when(F.col("excluded"), F.col("n") <= UNITS - F.least("r", ranked)).otherwise(F.col("n") <= ranked)).select("request", "unit", "excluded")


@query("SELECT DISTINCT rule, place, message FROM (SELECT 'L1' AS rule, source AS place, 'long text' AS message FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'L2', source, 'no words' FROM documents WHERE n_chars < 20 UNION ALL SELECT 'L1', source, 'long text' FROM documents WHERE n_chars > 9000) ORDER BY 1, 2, 3")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several rules, each once, by rule, place and message."""
    d = table(spark, sf_dir, "documents")
    rows = [d.where(cond).select(F.lit(rule).alias("rule"), F.col("source").alias("place"), F.lit(said).alias("message")) for rule, cond, said in (("L1", "n_chars > 5000", "long text"), ("L2", "n_chars < 20", "no words"), ("L1", "n_chars > 9000", "long text"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct().orderBy("rule", "place", "message")


@query("SELECT id FROM (SELECT n_name AS id FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier UNION SELECT p_brand FROM part)")
def private_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of facts, entities, references and artifacts that no answer may hold, each once."""
    names = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("part", "p_brand"))]
    return names[0].unionByName(names[1]).unionByName(names[2]).unionByName(names[3]).distinct()


@query("SELECT p_brand AS domain, array_to_string(list_sort(list_distinct(flatten(list(string_split(lower(p_type), ' '))))), ',') AS terms FROM part GROUP BY p_brand")
def merged_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a domain, from all manifests that name it."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    return rows.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@query("SELECT n_name AS release, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation")
def release_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of a world's few releases, from their list."""
    names = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return names.select(F.posexplode("r").alias("idx", "x")).select(F.col("x.n_name").alias("release"), F.col("idx").cast("bigint").alias("idx"))


@query("SELECT doc_id, left(sha256('artifact' || chr(31) || doc_id), 16) AS opaque_id, d.source FROM labels JOIN documents d USING (doc_id)")
def rows_by_opaque_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found by their opaque ids alone, whichever hub they are in."""
    opaque = lambda d: F.substring(F.sha2(F.concat(F.lit("artifact\x1f"), d).cast("binary"), 256), 1, 16)
    rows = table(spark, sf_dir, "documents").select("doc_id", opaque(F.col("doc_id")).alias("opaque_id"), "source")
    wanted = table(spark, sf_dir, "labels").select(opaque(F.col("doc_id")).alias("opaque_id"))
    return wanted.join(rows, "opaque_id").select("doc_id", "opaque_id", "source")


@query("SELECT s_suppkey AS entity, n_name AS ref FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> 'FRANCE'")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the world's references for them; an entity without one is left out."""
    refs = table(spark, sf_dir, "nation").where("n_name <> 'FRANCE'").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("ref"))
    return table(spark, sf_dir, "supplier").join(refs, "s_nationkey").select(F.col("s_suppkey").alias("entity"), "ref")


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)+'), lambda t: t NOT IN ('multi-step')))), ',') AS unresolved FROM benchmark")
def unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyphenated tokens of a question that nothing was matched with."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:-[a-z0-9]+)+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda t: t != "multi-step"))), ",").alias("unresolved"))


@query("SELECT doc_id, sha256(concat_ws(chr(10), 'doc_id', doc_id, 'lang', coalesce(lang, ''), 'n_chars', coalesce(n_chars::VARCHAR, ''), 'source', coalesce(source, ''), 'text', coalesce(text, ''))) AS public_hash FROM documents")
def public_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys and values of a row, keys sorted, a line each; a null is an empty line."""
    rows = table(spark, sf_dir, "documents")
    parts = [x for c in sorted(rows.columns) for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return rows.select("doc_id", F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256).alias("public_hash"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)\\b[0-9]+ (?:reserved|restricted|[a-z]+ are)\\b'), '|') AS phrases FROM documents WHERE regexp_matches(text, '(?i)\\b[0-9]+ (?:reserved|restricted|[a-z]+ are)\\b')")
def count_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that tell how many things a reader may not see."""
    pattern = r"(?i)\b[0-9]+ (?:reserved|restricted|[a-z]+ are)\b"
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "|").alias("phrases"))


@query("SELECT page_id, map_from_entries([('query', host), ('version', CASE WHEN page_id % 2 = 0 THEN 'R41' END)])['query'] AS query, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS arguments FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM pages WHERE url IS NOT NULL)")
def search_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of a search: those of the manifest that have a value, nothing else."""
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    given = F.map_filter(F.create_map(F.lit("query"), F.col("host"), F.lit("version"), F.when(F.col("page_id") % 2 == 0, "R41")), lambda k, v: v.isNotNull())
    return rows.select("page_id", F.element_at(given, "query").alias("query"), F.size(given).alias("arguments"))


@query("SELECT doc_id, 'answered' AS status, true AS call, CAST(NULL AS DOUBLE) AS p FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'unavailable', CAST(NULL AS BOOLEAN), NULL FROM labels WHERE doc_id % 2 = 1")
def rules_and_refusing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' provider keeps all it is asked about, without a probability; one that is not configured answers nothing."""
    rules = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "labels").select("doc_id", F.when(rules, "answered").otherwise("unavailable").alias("status"), F.when(rules, F.lit(True)).alias("call"), F.lit(None).cast("double").alias("p"))


@query("WITH p AS (SELECT a.o_custkey AS request, a.o_orderkey AS a, b.o_orderkey AS b, (a.o_orderkey + b.o_orderkey) % 100 / 100.0 AS p, a.o_orderstatus <> b.o_orderstatus AS flagged FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate AND a.o_orderpriority = b.o_orderpriority) SELECT request, a, b, flagged, NOT flagged AND p >= 0.7 AND request % 9 <> 0 AS promoted FROM p")
def promoted_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pairs stay flagged; a candidate pair is promoted only from the use band on, and only with a calibration."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    a, b = o.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("a.request") == F.col("b.request")) & (F.col("a.o_orderpriority") == F.col("b.o_orderpriority")) & (F.col("a.o_orderdate") < F.col("b.o_orderdate")))
    p, flagged = (F.col("a.o_orderkey") + F.col("b.o_orderkey")) % 100 / 100, F.col("a.o_orderstatus") != F.col("b.o_orderstatus")
    return pairs.select(F.col("a.request").alias("request"), F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), flagged.alias("flagged"), (~flagged & (p >= 0.7) & (F.col("a.request") % 9 != 0)).alias("promoted"))
