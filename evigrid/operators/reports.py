"""What is told about runs: results by family, gates, failing cases, stability of judgements, manifests, options, tables for readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.runs import read_lines, write_markdown
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import calls, table

_SCORES = "scores AS (SELECT o_orderkey AS c, o_orderpriority AS config, o_orderstatus AS family, o_totalprice > 100000 AS success, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 101 END AS recall FROM orders)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scored cases: priorities are arms, states families; one case in five has nothing to recall. Recall is in hundredths."""
    recall = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 101)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("family"), (F.col("o_totalprice") > 100000).alias("success"), recall.alias("recall"))


def by_family(scores: DataFrame) -> DataFrame:
    """(config, family, n, success, recall) with a row "all" for each config; recall counts only the cases that have one, null where none has."""
    sums = [F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success"), (F.avg("recall") / 100).alias("recall")]
    rows = scores.groupingSets([["config"], ["config", "family"]], "config", "family").agg(F.grouping("family").alias("whole"), *sums)
    return rows.select("config", F.when(F.col("whole") == 1, "all").otherwise(F.col("family")).alias("family"), "n", "success", "recall")


_FAMILIES = f"{_SCORES}, fam AS (SELECT config, CASE WHEN grouping(family) = 1 THEN 'all' ELSE family END AS family, count(*) AS n, avg(success::INT) AS success, avg(recall) / 100 AS recall FROM scores GROUP BY GROUPING SETS ((config), (config, family)))"


@query(f"WITH {_FAMILIES} SELECT config, family, n, round(success, 6) AS success, round(recall, 6) AS recall FROM fam")
def family_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and recall of each arm, by family and over all."""
    rows = by_family(_scores(spark, sf_dir))
    return rows.select("config", "family", "n", F.round("success", 6).alias("success"), F.round("recall", 6).alias("recall"))


def _shown(value: Column) -> Column:
    """Two places, or a dash for null."""
    return F.coalesce(F.format_string("%.2f", value), F.lit("-"))


def family_table(results: DataFrame, configs: Sequence[str]) -> DataFrame:
    """One row a family, "all" last, with the success and recall of each config; numbers as they are shown, a dash where there is none."""

    def of(name: str, config: str) -> Column:
        return _shown(F.max(F.when(F.col("config") == config, F.col(name)))).alias(f"{config} {name}")

    wide = results.groupBy("family").agg(*(of(name, c) for c in configs for name in ("success", "recall")))
    return wide.orderBy(F.col("family") == "all", "family")


@query(f"""WITH {_FAMILIES}, w AS (SELECT family, list(coalesce(printf('%.2f', success), '-') || ' | ' || coalesce(printf('%.2f', recall), '-') ORDER BY config) AS cells FROM fam GROUP BY family),
names AS (SELECT list(config || ' success | ' || config || ' recall' ORDER BY config) AS h FROM (SELECT DISTINCT config FROM scores)),
body AS (SELECT row_number() OVER (ORDER BY family = 'all', family) + 2 AS line, '| ' || family || ' | ' || array_to_string(cells, ' | ') || ' |' AS text FROM w)
SELECT 1::BIGINT AS line, '| family | ' || array_to_string(h, ' | ') || ' |' AS text FROM names UNION ALL SELECT 2, '|' || repeat('---|', 1 + 2 * len(h)) FROM names UNION ALL SELECT line, text FROM body""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table by family as a Markdown file, and the lines of that file."""
    path, configs = shared_folder(spark), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    write_markdown(family_table(by_family(_scores(spark, sf_dir)), configs), path)
    return read_lines(spark, path)


#: Gates of a run: each holds in all cases or fails.
GATES = {"no_leak": "leaks = 0", "in_scope": "in_scope", "entities": "wrong_entities = 0", "budget": "used <= budget", "reorder_only": "reorder_only"}


def gates(cases: DataFrame) -> DataFrame:
    """(run, cases, each gate, ok, over_budget) of a run's cases; a gate that a case says nothing about fails there."""
    held = {name: F.coalesce(F.expr(test), F.lit(False)) for name, test in GATES.items()}
    rows = cases.groupBy("run").agg(F.count("*").alias("cases"), *(F.bool_and(h).alias(name) for name, h in held.items()), F.count_if(~held["budget"]).alias("over_budget"))
    return rows.withColumn("ok", F.expr(" AND ".join(GATES)))


@query("""WITH g AS (SELECT o_custkey AS run, o_orderkey % 50 > 0 AS a, CASE WHEN o_orderkey % 31 > 0 THEN true END AS b, o_orderkey % 41 > 0 AS c, o_totalprice <= 300000 AS d, o_orderkey % 61 > 0 AS e FROM orders),
r AS (SELECT run, count(*) AS cases, bool_and(a) AS no_leak, bool_and(coalesce(b, false)) AS in_scope, bool_and(c) AS entities, bool_and(d) AS budget, bool_and(e) AS reorder_only, count(*) FILTER (NOT d) AS over_budget FROM g GROUP BY run)
SELECT *, no_leak AND in_scope AND entities AND budget AND reorder_only AS ok FROM r""")
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as cases: gates are passed or failed, never averaged."""
    key = F.col("o_orderkey")
    columns = {"run": F.col("o_custkey"), "leaks": (key % 50 == 0).cast("int"), "in_scope": F.when(key % 31 > 0, True), "wrong_entities": (key % 41 == 0).cast("int"), "used": F.col("o_totalprice"), "budget": F.lit(300000), "reorder_only": key % 61 > 0}
    return gates(table(spark, sf_dir, "orders").select(*(c.alias(n) for n, c in columns.items())))


@query(f"WITH {_SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY c) AS line FROM scores) SELECT config, c AS \"case\", '- ' || c || ' (' || family || '): ' || CASE WHEN coalesce(recall, 100) < 20 THEN 'recall' ELSE 'quality' END || ' [receipt](receipts.jsonl#L' || line || ')' AS text FROM n WHERE NOT success")
def failing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each case that failed, with what failed and a link to its receipt's line."""
    rows = running(_scores(spark, sf_dir), ["config"], ["case"], F.lit(1), "line")
    why = F.when(F.coalesce("recall", F.lit(100)) < 20, "recall").otherwise("quality")
    text = F.concat(F.lit("- "), "case", F.lit(" ("), "family", F.lit("): "), why, F.lit(" [receipt](receipts.jsonl#L"), "line", F.lit(")"))
    return rows.where(~F.col("success")).select("config", "case", text.alias("text"))


def stability(judgements: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(comparison, n, mean_diff, max_diff): how far judgements (case, source, way, at, p) of the same thing asked in two ways differ.

    Asked twice in one way, the later answer counts. What was asked in only one of both ways takes no part. Each thing's answers
    meet once, for all comparisons.
    """
    ways = sorted({w for pair in pairs for w in pair})
    answers = judgements.where(F.col("way").isin(*ways) & F.col("p").isNotNull()).groupBy("case", "source").agg(*(F.max_by("p", F.when(F.col("way") == w, F.col("at"))).alias(w) for w in ways))
    compared = F.explode(F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.abs(F.col(a) - F.col(b)).alias("d")) for a, b in pairs))).alias("c")
    found = answers.select(compared).select("c.*").groupBy("comparison").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.max("d").alias("x"))
    return found.select("comparison", "n", F.round("m", 4).alias("mean_diff"), F.round("x", 4).alias("max_diff"))


@query("""WITH j AS (SELECT user_id, event_type, event_id % 3 AS way, arg_max(1 / (1 + value / 50), event_id) AS p FROM events GROUP BY ALL),
d AS (SELECT a.way AS a, b.way AS b, abs(a.p - b.p) AS d FROM j a JOIN j b USING (user_id, event_type) WHERE a.way = 0 AND b.way > 0)
SELECT CASE b WHEN 1 THEN 'sorted vs repeat' ELSE 'sorted vs reversed' END AS comparison, count(*) AS n, round(avg(d), 4) AS mean_diff, round(max(d), 4) AS max_diff FROM d GROUP BY b""")
def order_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as judgements of a request's sources, asked in three ways."""
    way = F.get(F.array(*map(F.lit, ("sorted", "repeat", "reversed"))), (F.col("call_id") % 3).cast("int"))
    rows = calls(spark, sf_dir).select(F.col("request_id").alias("case"), F.col("source_id").alias("source"), way.alias("way"), F.col("call_id").alias("at"), (1 / (1 + F.col("latency") / 50)).alias("p"))
    return stability(rows, [("sorted", "repeat"), ("sorted", "reversed")])


@query("""WITH f AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS file FROM orders), n AS (SELECT s, count(*) AS n FROM f GROUP BY s), b AS (SELECT a.s AS a, b.s AS b, count(*) AS both_ FROM f a JOIN f b USING (file) WHERE a.s < b.s GROUP BY ALL)
SELECT x.s AS first_set, y.s AS second_set, x.n + y.n - coalesce(both_, 0) AS files, coalesce(both_, 0) AS twice, coalesce(both_, 0) > 0 AS refused FROM n x JOIN n y ON x.s < y.s LEFT JOIN b ON b.a = x.s AND b.b = y.s""")
def combined_case_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as case sets, customers as their files: two sets that share a file may not be combined."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("file"))
    sets = files.groupBy("file").agg(F.array_sort(F.collect_set("s")).alias("sets"))  # a file is in no more than the three sets
    n = sets.select(F.explode("sets").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    shared = sets.select(F.explode("sets").alias("a"), "sets").select("a", F.explode("sets").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("twice"))
    x, y = n.select(F.col("s").alias("a"), F.col("n").alias("m")), n.select(F.col("s").alias("b"), F.col("n").alias("k"))
    twice = F.coalesce("twice", F.lit(0))
    pairs = x.join(y, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left")  # three sets
    return pairs.select(F.col("a").alias("first_set"), F.col("b").alias("second_set"), (F.col("m") + F.col("k") - twice).alias("files"), twice.alias("twice"), (twice > 0).alias("refused"))


def manifests(model_calls: DataFrame, provider: str, state: dict[str, str]) -> DataFrame:
    """(run, provider, calls, models, state's columns): the models that answered a run's calls, sorted, and the state of the code, such as its commit."""
    models = F.array_join(F.array_sort(F.collect_set("model")), ",")
    return model_calls.groupBy("run").agg(F.count("*").alias("calls"), models.alias("models")).withColumns({"provider": F.lit(provider), **{k: F.lit(v) for k, v in state.items()}})


@query("""WITH c AS (SELECT user_id AS run, CASE WHEN event_type <> 'error' THEN 'm' || CAST(props->>'$.k' AS BIGINT) % 4 END AS model FROM events)
SELECT run, count(*) AS calls, coalesce(array_to_string(list_sort(list_distinct(list(model) FILTER (model IS NOT NULL))), ','), '') AS models, 'example' AS provider, '0123abc' AS commit, 'false' AS dirty FROM c GROUP BY run""")
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs, their events as calls of models; an error has no model."""
    model = F.when(F.col("event_type") != "error", F.concat(F.lit("m"), F.get_json_object("props", "$.k").cast("bigint") % 4))
    return manifests(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), model.alias("model")), "example", {"commit": "0123abc", "dirty": "false"})


def run_requests(cases: DataFrame, aliases: DataFrame, budget: int | None = None, deadline: int | None = None) -> DataFrame:
    """Cases (case, reader, budget, deadline) as a run sends them: readers under their aliases (reader, alias), a run's own limits in place of the cases'."""
    own = {"budget": budget, "deadline": deadline}
    limits = [F.coalesce(F.lit(v).cast("bigint"), F.col(k).cast("bigint")).alias(k) for k, v in own.items()]
    return cases.join(aliases, "reader", "left").select("case", F.coalesce("alias", "reader").alias("reader"), *limits)


@query("SELECT c_custkey AS \"case\", CASE WHEN n_regionkey < 3 THEN 'reader-' || n_nationkey ELSE n_name END AS reader, 4000::BIGINT AS budget, (1000 + c_custkey % 7)::BIGINT AS deadline FROM customer JOIN nation ON n_nationkey = c_nationkey")
def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, nations as readers, those of three regions with an alias; the run sets the budget and leaves the deadline."""
    nation = table(spark, sf_dir, "nation")
    cases = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("case"), F.col("n_name").alias("reader"), F.lit(2000).alias("budget"), (1000 + F.col("c_custkey") % 7).alias("deadline"))
    aliases = nation.where("n_regionkey < 3").select(F.col("n_name").alias("reader"), F.concat(F.lit("reader-"), "n_nationkey").alias("alias"))
    return run_requests(cases, aliases, budget=4000)


@query("""SELECT c_custkey AS caller, CASE WHEN c_custkey % 7 > 0 THEN count(event_id) END AS delivered, CASE WHEN c_custkey % 7 > 0 THEN max(event_id) END AS cursor_ FROM customer LEFT JOIN events ON user_id = c_custkey AND event_id > 100 AND event_type <> 'error' GROUP BY c_custkey""")
def verified_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is delivered to each caller after a cursor: null to one that is not verified, nothing to one without events."""
    callers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("caller"), (F.col("c_custkey") % 7 > 0).alias("verified"))
    own = calls(spark, sf_dir).where("call_id > 100 AND outcome = 'ok'").groupBy(F.col("request_id").alias("caller")).agg(F.count("*").alias("n"), F.max("call_id").alias("last"))
    shown = callers.join(own, "caller", "left")
    return shown.select("caller", F.when(F.col("verified"), F.coalesce("n", F.lit(0))).alias("delivered"), F.when(F.col("verified"), F.col("last")).alias("cursor_"))
