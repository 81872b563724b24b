"""Flagged pairs of units against the relations that were expected between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.assembly import _UNITS, conflict_pairs
from evigrid.plans.registry import query
from evigrid.sources.tables import table

_PLACE = ["request", "source", "artifact", "version"]


def witnessed(flagged: DataFrame, units: DataFrame, spans: DataFrame) -> DataFrame:
    """(request, a, b, relation, matched, expected) of flagged pairs (request, a, b, relation): the first expected relation that a pair witnesses, null without one.

    units: what was returned, (request, unit, source, artifact, version, start, end). spans: of the expected relations' two witnesses, (request, ord, expected, side,
    source, artifact, version, start, end), side being a or b; each witness has spans. A unit satisfies a witness if it covers all its spans; a pair
    witnesses a relation if its units satisfy both witnesses, in either order. A unit that was not returned satisfies none.
    """
    n = spans.groupBy("request", "ord", "side").agg(F.count("*").alias("n"))
    met = spans.join(units.withColumnsRenamed({"start": "from", "end": "to"}), _PLACE).where("from <= start AND end <= to")
    held = met.groupBy("request", "ord", "expected", "side", "unit").agg(F.count("*").alias("covered")).join(n, ["request", "ord", "side"]).where("covered = n")
    one = held.select("request", "ord", "expected", F.col("side").alias("side_a"), F.col("unit").alias("a"))
    two = held.select("request", "ord", F.col("side").alias("side_b"), F.col("unit").alias("b"))
    both = flagged.join(one, ["request", "a"]).join(two, ["request", "ord", "b"]).where("side_a <> side_b")
    first = both.groupBy("request", "a", "b").agg(F.min(F.struct("ord", "expected")).alias("m"))
    return flagged.join(first, ["request", "a", "b"], "left").select("request", "a", "b", "relation", F.col("m.ord").alias("matched"), F.col("m.expected").alias("expected"))


def conflict_scores(pairs: DataFrame, expecting: DataFrame) -> DataFrame:
    """(request, flagged, false_flags, unexpected, type_accuracy) by request of pairs as witnessed() gives them.

    false_flags: all flagged pairs of a request that expects no relation (requests that do are in expecting), else 0. unexpected: flagged pairs that witness no
    expected relation. type_accuracy: of those that do, the share with the expected type; null without any.
    """
    known = expecting.select("request").distinct().withColumn("expects", F.lit(True))
    per = pairs.groupBy("request").agg(F.count("*").alias("flagged"), F.count_if(F.col("matched").isNull()).alias("unexpected"), F.round(F.avg(F.when(F.col("matched").isNotNull(), (F.col("relation") == F.col("expected")).cast("int"))), 6).alias("type_accuracy"))
    return per.join(known, "request", "left").select("request", "flagged", F.when(F.col("expects"), 0).otherwise(F.col("flagged")).alias("false_flags"), "unexpected", "type_accuracy")


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as returned units of their customers, and an expected relation between each two orders of a customer with neighbouring numbers, for two customers in three."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 50).alias("artifact"), F.col("o_orderstatus").alias("version"))
    units = o.withColumn("start", F.lit(0)).withColumn("end", F.when(F.col("unit") % 3 == 0, 700).otherwise(1000))
    ranked = o.where("request % 3 < 2").select("request", F.struct("unit", "source", "artifact", "version").alias("u"))
    order = ranked.groupBy("request").agg(F.array_sort(F.collect_list("u")).alias("us")).where(F.size("us") > 1)  # a customer's orders: some tens
    both = order.select("request", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("us") - 1), lambda i: F.struct(F.try_element_at("us", i).alias("a"), F.try_element_at("us", i + 1).alias("b")))).alias("ord", "p"))
    both = both.where("p.a.unit < p.b.unit")
    expected = F.when(F.col("p.a.unit") % 2 == 0, "version").otherwise("contradiction")
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("p.a").alias("w")), F.struct(F.lit("b").alias("side"), F.col("p.b").alias("w")))).alias("s")
    rows = both.select("request", "ord", expected.alias("expected"), sides).select("request", "ord", "expected", "s.side", "s.w.*")
    places = F.explode(F.array(F.struct(F.lit(100).alias("start"), F.lit(600).alias("end")), F.struct(F.lit(500).alias("start"), (F.lit(600) + 100 * (F.col("unit") % 4)).cast("int").alias("end")))).alias("x")
    return units, rows.select("request", "ord", "expected", "side", "source", "artifact", "version", places).select("*", "x.start", "x.end").drop("x")


@query(f"""{_UNITS}, c AS (SELECT request, a.unit AS a, b.unit AS b, CASE WHEN a.o_orderdate <> b.o_orderdate AND a.value = 'F' THEN 'version' ELSE 'contradiction' END AS relation, row_number() OVER (PARTITION BY request ORDER BY a.rank, b.rank) AS n FROM v a JOIN v b USING (request)
  WHERE a.attribute = b.attribute AND a.rank < b.rank AND a.value <> b.value AND a.rank <= 8 AND b.rank <= 8 QUALIFY n <= 6),
u AS (SELECT o_custkey AS request, o_orderkey AS unit, o_orderpriority AS source, o_orderkey % 50 AS artifact, o_orderstatus AS version, CASE WHEN o_orderkey % 3 = 0 THEN 700 ELSE 1000 END AS upto FROM orders),
r AS (SELECT request, unit AS ua, lead(unit) OVER w AS ub, row_number() OVER w - 1 AS ord, CASE WHEN unit % 2 = 0 THEN 'version' ELSE 'contradiction' END AS expected FROM u WHERE request % 3 < 2 WINDOW w AS (PARTITION BY request ORDER BY unit)),
h AS (SELECT r.request, ord, expected, side, t.unit FROM (SELECT *, unnest(['a', 'b']) AS side, unnest([ua, ub]) AS x FROM r WHERE ub IS NOT NULL) r JOIN u w ON w.unit = x JOIN u t ON t.request = r.request AND t.source = w.source AND t.artifact = w.artifact AND t.version = w.version WHERE t.upto >= greatest(600, 600 + 100 * (x % 4))),
m AS (SELECT c.request, c.a, c.b, c.relation, arg_min(x.expected, x.ord) AS expected FROM c LEFT JOIN (SELECT p.request, p.ord, p.expected, p.unit AS a, q.unit AS b FROM h p JOIN h q ON p.request = q.request AND p.ord = q.ord AND p.side <> q.side) x ON x.request = c.request AND x.a = c.a AND x.b = c.b GROUP BY ALL)
SELECT request, count(*) AS flagged, CASE WHEN request IN (SELECT request FROM r WHERE ub IS NOT NULL) THEN 0 ELSE count(*) END AS false_flags, count(*) FILTER (expected IS NULL) AS unexpected, round(avg(CAST(relation = expected AS INT)), 6) AS type_accuracy FROM m GROUP BY request""")
def conflicts_against_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pairs of each customer, scored by both definitions of a false one and by their type."""
    units, spans = _expected(spark, sf_dir)
    flagged = conflict_pairs(spark, sf_dir).select("request", F.col("left_unit").alias("a"), F.col("right_unit").alias("b"), "relation")
    return conflict_scores(witnessed(flagged, units, spans), spans)
