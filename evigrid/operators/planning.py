"""Which sources a request may and must ask, and what its names denote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table


@query("SELECT source, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS groups, bool_or(lang IN ('fr','de')) AS allowed FROM documents GROUP BY source")
def allowed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("g"))
    return d.select("source", F.array_join("g", ",").alias("groups"), F.arrays_overlap("g", F.array(F.lit("fr"), F.lit("de"))).alias("allowed"))


@query("SELECT user_id AS request_id, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS wanted, count(DISTINCT event_type) FILTER (event_type IN ('purchase','click')) > 0 AS fits FROM events GROUP BY 1")
def wanted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.sort_array(F.collect_set("source_id"))
    return calls(spark, sf_dir).groupBy("request_id").agg(F.array_join(k, ",").alias("wanted"), F.arrays_overlap(k, F.array(F.lit("purchase"), F.lit("click"))).alias("fits"))


@query("WITH w AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type FROM events), m AS (SELECT * FROM (VALUES ('purchase','error'),('signup','click')) t(trigger_, must)) SELECT w.user_id AS reader, w.hour, m.must AS source_id FROM w JOIN m ON w.event_type = m.trigger_ WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.user_id = w.user_id AND x.hour = w.hour AND x.event_type = m.must)")
def must_consult(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a request's procedures require and that it did not ask: visible gaps, without a call. A request is a reader's hour."""
    w = calls(spark, sf_dir).select(F.col("request_id").alias("reader"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "source_id").distinct()
    must = spark.createDataFrame([("purchase", "error"), ("signup", "click")], "source_id string, must string")
    due = w.join(F.broadcast(must), "source_id").select("reader", "hour", F.col("must").alias("source_id"))
    return due.join(w, ["reader", "hour", "source_id"], "left_anti")


@query("SELECT page_id, CASE WHEN url LIKE 'https://blog.%' THEN 'https://blog.' WHEN starts_with('https://blog.', url) THEN 'https://blog.' ELSE NULL END AS selector, NOT starts_with(url, 'https://blog.') AS conflict FROM pages")
def selector_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selectors agree when one begins with the other."""
    a, b = F.col("url"), F.lit("https://blog.")
    ok = F.startswith(a, b)
    return table(spark, sf_dir, "pages").select("page_id", F.when(ok | F.startswith(b, a), b).alias("selector"), (~ok).alias("conflict"))


@query("SELECT c_custkey, n_name AS name, r_name AS member_of FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to entities to the groups they belong to, over small dimensions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("n_name").alias("name"), F.col("r_name").alias("member_of"))


@query("SELECT a.s_suppkey AS entity, count(*) AS siblings FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1")
def homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other entities that share a native name, by counts per name rather than a self join."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey")
    n = s.groupBy("s_nationkey").agg((F.count("*") - 1).alias("siblings"))
    return s.join(n, "s_nationkey").where("siblings > 0").select("entity", "siblings")


@query("SELECT p_brand AS label, count(DISTINCT p_type) AS entities, CASE WHEN count(DISTINCT p_type) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part GROUP BY p_brand")
def denotation_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.countDistinct("p_type").alias("entities"))
    return d.withColumn("status", F.when(F.col("entities") == 1, "resolved").otherwise("ambiguous"))
