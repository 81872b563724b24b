"""From ranked candidates to evidence: copies, conflicts, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import calls, table


def deduplicated(units: DataFrame, key: str, rank: str, authoritative: str) -> DataFrame:
    """Of equal content, the first authoritative unit, else the first, with the number of its copies; it keeps its own rank."""
    order = F.struct((~F.col(authoritative)).alias("o"), F.col(rank).alias("r"))
    return units.groupBy(key).agg(F.min(order).alias("m"), (F.count("*") - 1).alias("copies")).select(key, F.col("m.r").alias(rank), "copies")


#: Units of a group that are folded in one go.
STEP = 1000


def greedy_pack(units: DataFrame, group: str, rank: str, cost: str, budget: int, step: int = STEP) -> DataFrame:
    """(group, rank) of the units that go in, in rank order; one that does not fit is skipped and smaller ones still go in.

    Each round folds the first `step` units of every group, then drops what can no longer fit, until no group has more: no list grows
    with a group, and groups of fewer units take one round. Costs are whole numbers from 0 on; units that cost nothing always go in, units without a cost never. Ranks are unique in a group.
    """
    units = units.select(F.col(group).alias("g"), F.col(rank).cast("bigint").alias("rank"), F.col(cost).cast("bigint").alias("cost"))
    taken = [units.where("cost = 0").select("g", "rank")]
    left = units.where((F.col("cost") > 0) & (F.col("cost") <= budget)).withColumn("room", F.lit(budget).cast("bigint"))
    first = F.row_number().over(Window.partitionBy("g").orderBy("rank"))

    def fold(acc, x):
        fits = x["cost"] <= acc["room"]
        return F.struct(F.when(fits, acc["room"] - x["cost"]).otherwise(acc["room"]).alias("room"), F.when(fits, F.array_append(acc["taken"], x["rank"])).otherwise(acc["taken"]).alias("taken"))

    while True:
        start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("taken"))
        lists = left.withColumn("n", first).where(F.col("n") <= step).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", "cost"))).alias("u"), F.min("room").alias("room"))
        whole = F.when(F.size("u") == step, F.element_at("u", -1)["rank"])
        folded = written(lists.select("g", whole.alias("last"), F.aggregate("u", start, fold).alias("f")).select("g", "last", "f.*"))
        taken.append(folded.select("g", F.explode("taken").alias("rank")))
        state = folded.where("last IS NOT NULL AND room > 0").select(F.col("g").alias("h"), "last", F.col("room").alias("rest"))
        if state.isEmpty():
            break
        left = left.drop("room").join(state, F.col("g").eqNullSafe(F.col("h"))).where("rank > last AND cost <= rest")
        left = written(left.select("g", "rank", "cost", F.col("rest").alias("room")))
    return reduce(DataFrame.unionByName, taken).select(F.col("g").alias(group), F.col("rank").alias(rank))


@query("SELECT text_hash, CAST(substr(m, 3) AS BIGINT) AS doc_id, copies FROM (SELECT sha256(text) AS text_hash, min(CAST(source <> 'src0' AS INT) || ':' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS m, count(*) - 1 AS copies FROM documents GROUP BY 1)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), (F.col("source") == "src0").alias("own"))
    return deduplicated(rows, "text_hash", "doc_id", "own")


@query("WITH k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text ORDER BY source <> 'src0', doc_id) AS kept FROM documents) SELECT doc_id, kept AS duplicate_of FROM k WHERE doc_id <> kept")
def dup_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that are left out, with what stands for them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), (F.col("source") == "src0").alias("own"))
    kept = deduplicated(rows, "h", "doc_id", "own").where("copies > 0").select("h", F.col("doc_id").alias("duplicate_of"))
    return rows.join(kept, "h").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


@query("""WITH RECURSIVE u AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
p AS (SELECT source, rn, doc_id, CASE WHEN n_chars <= 9000 THEN n_chars ELSE 0 END AS used, n_chars <= 9000 AS took FROM u WHERE rn = 1
  UNION ALL SELECT u.source, u.rn, u.doc_id, CASE WHEN p.used + u.n_chars <= 9000 THEN p.used + u.n_chars ELSE p.used END, p.used + u.n_chars <= 9000 FROM p JOIN u ON u.source = p.source AND u.rn = p.rn + 1)
SELECT source, doc_id FROM p WHERE took""", name="greedy_pack")
def greedy_pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_pack(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 9000)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 9000")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prefix inside the budget: unlike packing, it stops at the first unit that does not fit."""
    units = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return running(units, ["source"], ["doc_id"], F.col("n_chars"), "used").where("used <= 9000").select("source", "doc_id")


@query("SELECT request_id, source_id, call_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY source_id, pos) AS n FROM (SELECT user_id AS request_id, event_type AS source_id, event_id AS call_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pos FROM events) WHERE pos <= 5) WHERE n <= 12")
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hits of each search, then a budget for the request, first come by source and rank."""
    by_search = F.row_number().over(Window.partitionBy("request_id", "source_id").orderBy("ts", "call_id"))
    by_request = F.row_number().over(Window.partitionBy("request_id").orderBy("source_id", "pos"))
    rows = calls(spark, sf_dir).select("request_id", "source_id", "call_id", "ts", by_search.alias("pos")).where("pos <= 5")
    return rows.withColumn("n", by_request).where("n <= 12").select("request_id", "source_id", "call_id")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id AS request_id, event_id AS call_id FROM n WHERE rn <= greatest(0, least(n - 1, CAST(floor(n * 0.6) AS BIGINT)))")
def partial_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial answers keep a share of their rows and always lose one."""
    rows = calls(spark, sf_dir).select("request_id", "call_id")
    n = rows.groupBy("request_id").agg(F.count("*").alias("n"))
    ranked = running(rows, ["request_id"], ["call_id"], F.lit(1), "rn").join(n, "request_id")
    return ranked.where(F.col("rn") <= F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.6))))).select("request_id", "call_id")


_NUMBERS = "SELECT doc_id, CAST(min(i) AS BIGINT) AS line, arg_min(v, i) AS value FROM (SELECT doc_id, i, regexp_extract(lines[i], '[0-9]+') AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE v <> '' GROUP BY doc_id"


@query(_NUMBERS)
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of each document, with its line."""
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    found = lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"), F.regexp_extract("t", "[0-9]+", 0).alias("value")).where("value <> ''")
    return found.groupBy("doc_id").agg(F.min("line").alias("line"), F.min_by("value", "line").alias("value"))


_UNITS = "WITH v AS (SELECT o_custkey AS request, o_orderpriority AS attribute, o_orderkey AS unit, o_orderstatus AS value, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


@query(f"{_UNITS}, p AS (SELECT a.request, a.unit AS left_unit, b.unit AS right_unit, row_number() OVER (PARTITION BY a.request ORDER BY a.rank, b.rank) AS n, CASE WHEN a.o_orderdate <> b.o_orderdate AND a.value = 'F' THEN 'version' ELSE 'contradiction' END AS relation FROM v a JOIN v b ON a.request = b.request AND a.attribute = b.attribute AND a.rank < b.rank AND a.value <> b.value WHERE a.rank <= 8 AND b.rank <= 8) SELECT request, left_unit, right_unit, relation FROM p WHERE n <= 6")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among a request's first eight units that give one attribute different values, six at most, with their relation."""
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("o_totalprice"), "unit"))
    v = o.select(F.col("o_custkey").alias("request"), F.col("o_orderpriority").alias("attribute"), F.col("o_orderkey").alias("unit"), F.col("o_orderstatus").alias("value"), "o_orderdate", "o_totalprice")
    v = v.withColumn("rank", rank).where("rank <= 8")
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, (F.col("a.request") == F.col("b.request")) & (F.col("a.attribute") == F.col("b.attribute")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("a.value") != F.col("b.value")))
    relation = F.when((F.col("a.o_orderdate") != F.col("b.o_orderdate")) & (F.col("a.value") == "F"), "version").otherwise("contradiction")
    pairs = pairs.select(F.col("a.request").alias("request"), F.col("a.unit").alias("left_unit"), F.col("b.unit").alias("right_unit"), relation.alias("relation"), F.col("a.rank").alias("i"), F.col("b.rank").alias("j"))
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("i", "j"))).where("n <= 6").select("request", "left_unit", "right_unit", "relation")
