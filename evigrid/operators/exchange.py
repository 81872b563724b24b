"""Questions put to a provider and the answers that come back: batches, validity, signals, violations of the wire's rules, a fit by descent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.calibration import counted
from evigrid.operators.ordering import running
from evigrid.operators.statistics import _CAL
from evigrid.plans.registry import query
from evigrid.sources.tables import calibration_records, table

#: What a provider declares: kinds of questions, questions a call, options a question, characters of a call's state, calls a request.
PRIMITIVES, QUESTIONS, OPTIONS, STATE, ROUND_CALLS = ("click", "view", "signup", "purchase"), 20, 90, 600, 30


def question_calls(questions: DataFrame, primitives: tuple[str, ...] = PRIMITIVES, size: int = QUESTIONS, options: int = OPTIONS, state: int = STATE, calls: int = ROUND_CALLS) -> DataFrame:
    """(request, question, status, call) of questions (request, question, primitive, options, chars); call counts from 0 and only what is asked has one.

    A question of a kind that is not offered, or with too many options, is refused. The others go by their order in batches of
    `size`, which are cut where the next question would exceed `state`; one that exceeds it alone is too large. A request of more
    than `calls` calls is over its budget and asks nothing. A null kind or number is refused. Ids of questions are unique in a request.
    Only one batch's questions are ever in an array; numbers over a request come from ranges of it.
    """
    fits = F.coalesce(F.col("primitive").isin(*primitives) & (F.col("options") <= options) & F.col("chars").isNotNull(), F.lit(False))
    q = questions.select("request", "question", F.col("chars").cast("bigint").alias("chars"), fits.alias("fits"))
    kept = running(q.where("fits").drop("fits"), ["request"], ["question"], F.lit(1), "n")
    batches = kept.groupBy("request", F.expr(f"cast((n - 1) div {size} as bigint)").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("question", "chars"))).alias("own"))

    def put(acc: Column, x: Column) -> Column:
        alone = x["chars"] > state
        new = (acc["used"] + x["chars"] > state) & (acc["used"] > 0)
        part = F.when(alone, F.lit(None).cast("int")).otherwise(acc["part"] + new.cast("int"))
        used = F.when(alone, acc["used"]).when(new, x["chars"]).otherwise(acc["used"] + x["chars"])
        return F.struct(F.coalesce(part, acc["part"]).alias("part"), used.alias("used"), F.array_append(acc["out"], F.struct(x["question"].alias("question"), part.alias("part"))).alias("out"))

    empty = F.expr("filter(transform(own, x -> struct(x.question as question, cast(null as int) as part)), x -> false)")
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("used"), empty.alias("out"))
    cut = batches.select("request", "batch", F.aggregate("own", start, put)["out"].alias("out"))
    cut = cut.withColumn("parts", F.coalesce(F.array_max(F.transform("out", lambda x: x["part"])) + 1, F.lit(0)).cast("bigint"))
    cut = running(cut, ["request"], ["batch"], F.col("parts"), "upto")
    total = cut.groupBy("request").agg(F.sum("parts").alias("total"))
    asked = cut.join(total, "request").select("request", "total", (F.col("upto") - F.col("parts")).alias("first"), F.explode("out").alias("x"))
    status = F.when(F.col("x.part").isNull(), "too_large").when(F.col("total") > calls, "over_budget").otherwise("asked")
    asked = asked.select("request", "x.question", status.alias("status"), F.when(status == "asked", F.col("first") + F.col("x.part")).alias("call"))
    return asked.unionByName(q.where("NOT fits").select("request", "question", F.lit("refused").alias("status"), F.lit(None).cast("bigint").alias("call")))


_ASKED = f"""WITH RECURSIVE q AS (SELECT user_id AS request, event_id AS question, event_type IN ({", ".join(f"'{p}'" for p in PRIMITIVES)}) AND CAST(json_extract_string(props, '$.k') AS BIGINT) <= {OPTIONS} AS fits, CAST(floor(value * 6) AS BIGINT) AS chars FROM events),
b AS MATERIALIZED (SELECT request, question, chars, (row_number() OVER (PARTITION BY request ORDER BY question) - 1) // {QUESTIONS} AS batch, (row_number() OVER (PARTITION BY request ORDER BY question) - 1) % {QUESTIONS} AS i FROM q WHERE fits),
f AS (SELECT request, batch, -1 AS i, 0 AS part, 0::BIGINT AS used, NULL::BIGINT AS question, false AS alone FROM b WHERE i = 0 UNION ALL
SELECT b.request, b.batch, f.i + 1, CASE WHEN chars <= {STATE} AND used > 0 AND used + chars > {STATE} THEN part + 1 ELSE part END, CASE WHEN chars > {STATE} THEN used WHEN used > 0 AND used + chars > {STATE} THEN chars ELSE used + chars END, b.question, chars > {STATE} FROM f JOIN b ON b.request = f.request AND b.batch = f.batch AND b.i = f.i + 1),
p AS (SELECT request, batch, coalesce(max(part) FILTER (NOT alone) + 1, 0) AS parts FROM f WHERE i >= 0 GROUP BY ALL), u AS (SELECT *, sum(parts) OVER (PARTITION BY request ORDER BY batch) - parts AS first, sum(parts) OVER (PARTITION BY request) AS total FROM p)
SELECT request, question, CASE WHEN alone THEN 'too_large' WHEN total > {ROUND_CALLS} THEN 'over_budget' ELSE 'asked' END AS status, CASE WHEN NOT alone AND total <= {ROUND_CALLS} THEN CAST(first + part AS BIGINT) END AS call FROM f JOIN u USING (request, batch) WHERE i >= 0
UNION ALL SELECT request, question, 'refused', NULL FROM q WHERE NOT fits"""


@query(_ASKED)
def question_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as questions of their users: the kind is the type, the number of options the key, the size of the state six times the value."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    q = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("question"), F.col("event_type").alias("primitive"), k.alias("options"), F.floor(F.col("value") * 6).alias("chars"))
    return question_calls(q)


#: How far the probabilities of a choice may be from 1 in sum.
TOLERANCE = 0.01


def answer_valid(kind: Column, given: Column, options: Column, choice: Column, probabilities: Column, number: Column) -> Column:
    """Whether an answer is exactly what was asked: its kind, and for a probability 0 to 1, for a choice a declared option whose probabilities, all of
    declared options, sum to 1, for a score a number inside the declared levels (any, where none is declared)."""
    level = F.transform(options, lambda o: o.try_cast("double"))
    levels = (F.size(options) == 0) | F.exists(level, lambda x: x.isNull()) | number.between(F.array_min(level), F.array_max(level))
    values = F.map_values(probabilities)
    choices = F.array_contains(options, choice) & (F.size(F.array_except(F.map_keys(probabilities), options)) == 0) & F.forall(values, lambda p: p.between(0, 1))
    total = F.abs(F.aggregate(values, F.lit(0.0), lambda a, p: a + p) - 1) <= TOLERANCE
    right = F.when(kind == "noul", number.between(0, 1)).when(kind == "choice", choices & total).when(kind == "score", number.isNotNull() & levels)
    return F.coalesce((kind == given) & right, F.lit(False))


@query(f"""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'noul' WHEN 'view' THEN 'choice' ELSE 'score' END AS kind, value / 100 AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
v AS (SELECT event_id, user_id, k % 13 = 5 AS other, CASE WHEN k % 11 = 3 THEN false WHEN kind = 'noul' THEN u <= 1 WHEN kind = 'choice' THEN u <= 1 AND k % 7 <> 1 AND k % 5 <> 2 WHEN k % 2 = 0 THEN u * 4 <= 3 ELSE true END AS ok FROM e)
SELECT v.event_id AS question, ok AND NOT s.suspect AS valid FROM v JOIN (SELECT user_id, bool_or(other AND event_id % 40 = 0) AS suspect FROM v GROUP BY user_id) s USING (user_id)""")
def matched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as answers. One in eleven is of another kind; choices may name no option or sum to 1.2; even keys declare levels 0 to 3, odd ones unordered names.
    A call that answers what nobody asked is not believed at all."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    kind = F.when(F.col("event_type") == "click", "noul").when(F.col("event_type") == "view", "choice").otherwise("score")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), (F.col("value") / 100).alias("u"), k.alias("k"))
    options = F.when(F.col("kind") == "choice", F.array(F.lit("a"), F.lit("b"))).when(F.col("k") % 2 == 0, F.array(*map(F.lit, "0123"))).otherwise(F.array(F.lit("low"), F.lit("high")))
    choice = F.when(F.col("k") % 7 == 1, "c").otherwise("a")
    shares = F.create_map(F.lit("a"), F.col("u"), F.lit("b"), 1 - F.col("u") + F.when(F.col("k") % 5 == 2, 0.2).otherwise(0.0))
    number = F.when(F.col("kind") == "score", F.col("u") * 4).otherwise(F.col("u"))
    given = F.when(F.col("k") % 11 == 3, "none").otherwise(F.col("kind"))
    rows = e.select("event_id", "user_id", answer_valid(F.col("kind"), given, options, choice, shares, number).alias("ok"), ((F.col("k") % 13 == 5) & (F.col("event_id") % 40 == 0)).alias("other"))
    suspect = rows.where("other").select("user_id").distinct().withColumn("suspect", F.lit(True))
    return rows.join(suspect, "user_id", "left").select(F.col("event_id").alias("question"), (F.col("ok") & F.col("suspect").isNull()).alias("valid"))


_SIGNALS = """WITH p AS (SELECT l_orderkey AS o, count(*) AS asked, count(*) FILTER (l_returnflag <> 'R') AS answered, product(l_discount * 10) FILTER (l_returnflag <> 'R') AS product FROM lineitem GROUP BY 1)
SELECT 'order/' || l_orderkey AS item, 'part ' || l_linenumber AS signal, round(l_discount * 10, 6) AS value FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT 'order/' || o, 'product_diagnostic', round(product, 6) FROM p WHERE asked = answered
UNION ALL SELECT 'event/' || event_id, CASE event_type WHEN 'click' THEN 'p' WHEN 'view' THEN 'p_diagnostic' WHEN 'signup' THEN 'p_diagnostic' WHEN 'purchase' THEN 'p_relation_diagnostic' ELSE 'score_diagnostic' END,
round(CASE event_type WHEN 'click' THEN value / 100 WHEN 'view' THEN 1 - value / 100 WHEN 'signup' THEN value / 100 WHEN 'purchase' THEN 1 - value / 100 ELSE value / 100 * 3 / 3.0::DOUBLE END, 6) FROM events"""


def single_signals(answers: DataFrame) -> DataFrame:
    """(item, signal, value) of answers (item, kind, positive, diagnostic, value): only the probability of a positively put question is named p and may be calibrated."""
    p = F.when(F.col("positive") & ~F.col("diagnostic"), "p").otherwise("p_diagnostic")
    name = F.when(F.col("kind") == "noul", p).when(F.col("kind") == "choice", "p_relation_diagnostic").when(F.col("kind") == "score", "score_diagnostic")
    value = F.when((F.col("kind") == "noul") & F.col("positive"), F.col("value")).when(F.col("kind") == "score", F.col("value") / 3.0).otherwise(1 - F.col("value"))
    return answers.select("item", name.alias("signal"), value.alias("value")).where("signal IS NOT NULL AND value IS NOT NULL")


def part_signals(parts: DataFrame) -> DataFrame:
    """(item, signal, value) of questions asked in parts (item, part, value): each answered part, and the product where all are answered."""
    whole = parts.groupBy("item").agg(F.count("*").alias("asked"), F.count("value").alias("answered"), F.product("value").alias("value")).where("asked = answered")
    return parts.where("value IS NOT NULL").select("item", F.col("part").alias("signal"), "value").unionByName(whole.select("item", F.lit("product_diagnostic").alias("signal"), "value"))


@query(_SIGNALS)
def answer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as parts, returned ones unanswered; events as single answers, by type: p, negative, diagnostic, choice (the value is the share of no conflict) and score."""
    part = F.concat(F.lit("part "), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("item"), part.alias("part"), F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10).alias("value"))
    t = F.col("event_type")
    kind = F.when(t == "purchase", "choice").when(t == "error", "score").otherwise("noul")
    value = F.when(t == "error", F.col("value") / 100 * 3).otherwise(F.col("value") / 100)
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("item"), kind.alias("kind"), (t != "view").alias("positive"), (t == "signup").alias("diagnostic"), value.alias("value"))
    return part_signals(lines).unionByName(single_signals(events)).withColumn("value", F.round("value", 6))


#: Steps of a fit by descent, and their length.
STEPS, RATE = 3000, 0.3


def descent(rows: DataFrame, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """(fit, slope, intercept) of rows (fit, x, y, n), by steps of fixed length from slope 1 and intercept 0; one task a fit.

    Rows are counts of equal records. x comes from probabilities of six places, so that a fit has two million rows at most, whatever the records.
    """

    def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (f[c].to_numpy("float64") for c in ("x", "y", "n"))
        a, b, total = 1.0, 0.0, n.sum()
        for _ in range(steps):
            gap = n * (1 / (1 + np.exp(-(a * x + b))) - y)
            a, b = a - rate * (gap @ x) / total, b - rate * gap.sum() / total
        return pd.DataFrame({"fit": [key[0]], "slope": [a], "intercept": [b]})

    return rows.select("fit", "x", "y", "n").groupBy("fit").applyInPandas(fit, "fit string, slope double, intercept double")


@query(f"""WITH RECURSIVE {_CAL}, k AS MATERIALIZED (SELECT ln(greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE))) AS x, y, count(*)::DOUBLE AS n FROM cal GROUP BY ALL),
w AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - {RATE}::DOUBLE * sum(n * (1 / (1 + exp(-(a * x + b))) - y) * x) / sum(n), b - {RATE}::DOUBLE * sum(n * (1 / (1 + exp(-(a * x + b))) - y)) / sum(n) FROM w, k WHERE i < {STEPS} GROUP BY i, a, b)
SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM w WHERE i = {STEPS}""")
def platt_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = calibration_records(spark, sf_dir).withColumn("p_raw", F.round("p_raw", 6))
    fitted = descent(counted(records).withColumn("fit", F.lit("all")))
    return fitted.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


#: Stand-ins of reason codes: what each attaches to.
REASONS = {"click": ("response", "source"), "view": ("source",), "signup": ("response",), "purchase": ("response", "interpretation")}
# Parts of names that no field of a request may have, declared fields aside.
CREDENTIALS = ("token", "credential", "password", "secret", "principal", "api_key")


def violations(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is null is kept."""
    return F.filter(F.array(*(F.when(broken, name) for name, broken in rules)), lambda x: x.isNotNull())


def reason_rules(reason: Column, attach: Column, codes: dict[str, tuple[str, ...]]) -> list[tuple[str, Column]]:
    known = F.create_map(*(c for code, at in codes.items() for c in (F.lit(code), F.array(*map(F.lit, at)))))
    at = F.try_element_at(known, reason)
    return [("unknown reason", reason.isNotNull() & at.isNull()), ("reason cannot attach here", ~F.array_contains(at, attach))]


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL ELSE event_type END AS reason, CASE WHEN user_id % 2 = 0 THEN 'source' ELSE 'response' END AS attach, CASE WHEN k % 3 = 0 THEN 'skipped' WHEN k % 3 = 1 THEN 'unsupported_for_mode' ELSE 'ok' END AS status, k, value FROM e)
SELECT event_id, 'unknown reason' AS violation FROM r WHERE reason = 'error' UNION ALL
SELECT event_id, 'reason cannot attach here' FROM r WHERE (reason = 'view' AND attach = 'response') OR (reason IN ('signup', 'purchase') AND attach = 'source') UNION ALL
SELECT event_id, 'skipped without a reason' FROM r WHERE status = 'skipped' AND reason IS NULL UNION ALL
SELECT event_id, 'unsupported without a reason' FROM r WHERE status = 'unsupported_for_mode' AND reason IS NULL UNION ALL
SELECT event_id, 'known without its context' FROM r WHERE k % 5 = 0 AND (k % 7 = 0 OR k % 2 = 0) UNION ALL
SELECT event_id, 'unknown with a context' FROM r WHERE k % 5 = 1 AND (k % 7 <> 0 OR k % 2 <> 0) UNION ALL
SELECT event_id, 'no answer, yet a value' FROM r WHERE k % 6 = 0 AND value > 50 UNION ALL SELECT event_id, 'an answer without a value' FROM r WHERE k % 6 <> 0 AND value <= 50 UNION ALL
SELECT event_id, 'looks like a credential' FROM r WHERE k % 9 IN (1, 2)""")
def wire_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes, applicability, decisions and requests read from events, each with the rules it breaks, in one pass.

    Keys stand for what is filled in: k by 5 the applicability, k by 7 and by 2 the branch and the environment, k by 6 an answer that failed, k by 9 the name of an extra field.
    """
    k, value = F.get_json_object("props", "$.k").try_cast("bigint"), F.when(F.col("value") > 50, F.col("value"))
    reason, attach = F.when(k % 4 != 0, F.col("event_type")), F.when(F.col("user_id") % 2 == 0, "source").otherwise("response")
    status = F.when(k % 3 == 0, "skipped").when(k % 3 == 1, "unsupported_for_mode").otherwise("ok")
    applies = F.when(k % 5 == 0, "known").when(k % 5 == 1, "unknown").otherwise("partial")
    branch, environment = F.when(k % 7 != 0, "main"), F.when(k % 2 != 0, "prod")
    failed = k % 6 == 0
    field = F.when(k % 9 == 0, "budget_tokens").when(k % 9 == 1, "My_Token").when(k % 9 == 2, "API_KEY").otherwise("note")
    like = (field != "budget_tokens") & F.exists(F.array(*map(F.lit, CREDENTIALS)), lambda c: F.contains(F.lower(field), c))
    broken = violations(
        *reason_rules(reason, attach, REASONS),
        ("skipped without a reason", (status == "skipped") & reason.isNull()),
        ("unsupported without a reason", (status == "unsupported_for_mode") & reason.isNull()),
        ("known without its context", (applies == "known") & (branch.isNull() | environment.isNull())),
        ("unknown with a context", (applies == "unknown") & (branch.isNotNull() | environment.isNotNull())),
        ("no answer, yet a value", failed & value.isNotNull()),
        ("an answer without a value", ~failed & value.isNull()),
        ("looks like a credential", like),
    )
    return table(spark, sf_dir, "events").select("event_id", F.explode(broken).alias("violation"))


@query("""WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"request_id": "r' || user_id || '"}' WHEN 1 THEN '{"request_id": ' || user_id || '}' WHEN 2 THEN '{"request_id": "r' WHEN 3 THEN '["request_id"]' ELSE '{"other": 1}' END AS line FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN json_extract_string(line, '$.request_id') END AS request_id FROM l""")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request id of each written line; null where the line is no JSON object or its id is no text."""
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit('{"request_id": "r'), user)
    n = F.col("event_id") % 5
    line = F.when(n == 0, F.concat(line, F.lit('"}'))).when(n == 1, F.concat(F.lit('{"request_id": '), user, F.lit("}"))).when(n == 2, line).when(n == 3, '["request_id"]').otherwise('{"other": 1}')
    given = F.try_variant_get(F.try_parse_json(line), "$.request_id", "variant")
    return table(spark, sf_dir, "events").select("event_id", F.when(F.schema_of_variant(given) == "STRING", given.cast("string")).alias("request_id"))
