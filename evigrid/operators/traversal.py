"""Typed edges followed to any depth, with what a reader may see decided at each hop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import table


def reachable(edges: DataFrame, starts: DataFrame, hidden: DataFrame) -> DataFrame:
    """(reader, start, node, hops): what each reader gets to from each of starts (reader, start) over edges (source, target), by the fewest hops.

    A node in hidden (reader, node) is neither shown nor passed through; a hidden start leads nowhere. Cycles end, as each round only goes on from nodes that are
    new; there are as many rounds as the longest of the shortest paths has hops. The start itself is not among what is reached, even on a cycle.
    """
    frontier = starts.select("reader", "start", F.col("start").alias("node")).distinct().join(hidden, ["reader", "node"], "left_anti")
    seen = [written(frontier.withColumn("hops", F.lit(0)))]
    edges = edges.select(F.col("source").alias("node"), "target").distinct()
    while True:
        last = seen[-1].select("reader", "start", "node")
        onward = last.join(edges, "node").select("reader", "start", F.col("target").alias("node")).distinct().join(hidden, ["reader", "node"], "left_anti")
        known = reduce(DataFrame.unionByName, seen).select("reader", "start", "node")
        new = written(onward.join(known, ["reader", "start", "node"], "left_anti").withColumn("hops", F.lit(len(seen))))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, seen).where("hops > 0")
        seen.append(new)


def typed_path(edges: DataFrame, starts: DataFrame, hidden: DataFrame, types: list[str]) -> DataFrame:
    """(reader, start, node): where a path of exactly these types of edges (type, source, target) leads, each hop of it visible."""
    at = starts.select("reader", "start", F.col("start").alias("node")).distinct().join(hidden, ["reader", "node"], "left_anti")
    for t in types:
        step = edges.where(F.col("type") == t).select(F.col("source").alias("node"), "target")
        at = at.join(step, "node").select("reader", "start", F.col("target").alias("node")).distinct().join(hidden, ["reader", "node"], "left_anti")
    return at


READERS = ("p_en", "p_eu", "p_all")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers live in nations, nations are members of regions, a region borders the next one in a ring; some nodes are hidden from some readers."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    lives = c.select(F.lit("lives_in").alias("type"), node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target"))
    member = n.select(F.lit("member_of").alias("type"), node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target"))
    borders = r.select(F.lit("borders").alias("type"), node("r", "r_regionkey").alias("source"), F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string")).alias("target"))
    readers = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("reader")) for i, x in enumerate(READERS))))
    starts = c.select(readers.alias("x"), node("c", "c_custkey").alias("start")).select("x.reader", "start")
    hidden = [d.select(readers.alias("x"), F.col(key).alias("k"), node(kind, key).alias("node")).where((F.col("k") + F.col("x.i")) % m == 0) for d, kind, key, m in ((c, "c", "c_custkey", 13), (n, "n", "n_nationkey", 7), (r, "r", "r_regionkey", 4))]
    hidden = reduce(DataFrame.unionByName, hidden).where("x.i < 2").select("x.reader", "node")
    return lives.unionByName(member).unionByName(borders), starts, hidden


_GRAPH = """e AS (SELECT 'lives_in' AS type, 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 'member_of', 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'borders', 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 5 FROM region),
who AS (SELECT * FROM (VALUES (0, 'p_en'), (1, 'p_eu'), (2, 'p_all')) v(i, reader)),
hid AS (SELECT reader, 'c' || c_custkey AS node FROM customer, who WHERE i < 2 AND (c_custkey + i) % 13 = 0 UNION ALL SELECT reader, 'n' || n_nationkey FROM nation, who WHERE i < 2 AND (n_nationkey + i) % 7 = 0 UNION ALL SELECT reader, 'r' || r_regionkey FROM region, who WHERE i < 2 AND (r_regionkey + i) % 4 = 0),
s0 AS (SELECT reader, 'c' || c_custkey AS start FROM customer, who),
s AS (SELECT * FROM s0 ANTI JOIN (SELECT reader, node AS start FROM hid) USING (reader, start))"""


@query(f"WITH RECURSIVE {_GRAPH}, p AS (SELECT reader, start, start AS node, 0 AS hops FROM s UNION SELECT p.reader, p.start, e.target, hops + 1 FROM p JOIN e ON e.source = p.node WHERE hops < 9 AND NOT EXISTS (SELECT 1 FROM hid WHERE hid.reader = p.reader AND hid.node = e.target)) SELECT reader, start, node, CAST(min(hops) AS INT) AS hops FROM p WHERE node <> start GROUP BY ALL")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each reader gets to from each customer: up to seven hops, around a ring."""
    return reachable(*_graph(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT s.reader, s.start, c.target AS node FROM s JOIN e a ON a.source = s.start AND a.type = 'lives_in' JOIN e b ON b.source = a.target AND b.type = 'member_of' JOIN e c ON c.source = b.target AND c.type = 'borders' WHERE NOT EXISTS (SELECT 1 FROM hid WHERE hid.reader = s.reader AND hid.node IN (a.target, b.target, c.target))")
def typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that borders a customer's own, if the way there is visible."""
    return typed_path(*_graph(spark, sf_dir), ["lives_in", "member_of", "borders"])


@query(f"""WITH {_GRAPH}, by_edges AS (SELECT s0.start, c.target AS node FROM (SELECT DISTINCT start FROM s0) s0 JOIN e a ON a.source = s0.start AND a.type = 'lives_in' JOIN e b ON b.source = a.target AND b.type = 'member_of' JOIN e c ON c.source = b.target AND c.type = 'borders'),
by_tables AS (SELECT 'c' || c_custkey AS start, 'r' || (r_regionkey + 1) % 5 AS node FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT (SELECT count(*) FROM (FROM by_edges EXCEPT ALL FROM by_tables)) AS only_in_edges, (SELECT count(*) FROM (FROM by_tables EXCEPT ALL FROM by_edges)) AS only_in_tables, (SELECT count(*) FROM (FROM by_edges INTERSECT ALL FROM by_tables)) AS in_both""")
def edge_vs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of typed edges and separate tables answer alike: three hops over the edges against three joined tables."""
    edges, starts, hidden = _graph(spark, sf_dir)
    one = starts.where(F.col("reader") == READERS[-1])  # from whom nothing is hidden
    by_edges = typed_path(edges, one, hidden, ["lives_in", "member_of", "borders"]).select("start", "node")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    by_tables = joined.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"), F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string")).alias("node"))
    sides = by_edges.withColumn("e", F.lit(1)).withColumn("t", F.lit(0)).unionByName(by_tables.withColumn("e", F.lit(0)).withColumn("t", F.lit(1)))
    each = sides.groupBy("start", "node").agg(F.sum("e").alias("e"), F.sum("t").alias("t"))
    n = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0))
    return each.agg(n(F.col("e") - F.col("t")).alias("only_in_edges"), n(F.col("t") - F.col("e")).alias("only_in_tables"), n(F.least("e", "t")).alias("in_both"))
