"""Evidence against what was required: spans, obligations, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table

#: Characters of items that go out with one broadcast; more of them go in blocks.
BLOCK = 4 << 20


def required_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, lang, source, start, end): where a whole benchmark item first stands in a document, half-open, from 0.

    An item between whose first and last blank other words stand can only be in a document that has its longest such word between
    blanks too: an equi-join on that word finds the pairs to verify. Only items of one or two words are looked for everywhere.
    Items are the stated set of texts searched for: each block of them, by hash of the id, is one broadcast of a checked size.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    total = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK) or 1
    start = (F.instr("text", F.col("item")) - 1).cast("bigint")
    inner = F.split("item", " ")
    inner = F.filter(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = items.withColumn("anchor", longest)
    each = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))  # no text beside a word
    parts = []
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        met = each.join(F.broadcast(block.where("anchor IS NOT NULL")), F.expr("word = anchor")).drop("word", "anchor")
        parts.append(docs.join(met, "doc_id").where("contains(text, item)"))
        parts.append(docs.join(F.broadcast(block.where("anchor IS NULL").drop("anchor")), F.expr("contains(text, item)")))
    return reduce(DataFrame.unionByName, parts).select("item_id", "doc_id", "lang", "source", start.alias("start"), (start + F.length("item")).alias("end"))


_SPANS = "sp AS (SELECT b.item_id, d.doc_id, d.lang, d.source, instr(d.text, b.text) - 1 AS s, instr(d.text, b.text) - 1 + length(b.text) AS e FROM documents d, benchmark b WHERE contains(d.text, b.text))"


@query(f"WITH {_SPANS} SELECT item_id, doc_id, s AS start, e AS \"end\" FROM sp")
def leak_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return required_spans(spark, sf_dir).select("item_id", "doc_id", "start", "end")


@query(f"WITH {_SPANS}, u AS (SELECT doc_id, 0 AS us, n_chars // 2 AS ue FROM documents) SELECT item_id, sp.doc_id, s >= us AND e <= ue AS covered, us < e AND s < ue AS overlaps FROM sp JOIN u ON u.doc_id = sp.doc_id")
def span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span against a unit that is the first half of the same document."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("us"), F.expr("n_chars div 2").alias("ue"))
    j = required_spans(spark, sf_dir).join(units, "doc_id")
    return j.select("item_id", "doc_id", ((F.col("start") >= F.col("us")) & (F.col("end") <= F.col("ue"))).alias("covered"), ((F.col("us") < F.col("end")) & (F.col("start") < F.col("ue"))).alias("overlaps"))


_OBLIGED = f"WITH {_SPANS}, u AS (SELECT sp.item_id, sp.source AS bundle, bool_and(e <= n_chars // 2) AS held FROM sp JOIN documents d USING (doc_id) GROUP BY ALL), o AS (SELECT b.item_id, b.item_id % 3 + 1 AS weight, count(u.held) > 0 AS obtainable, coalesce(bool_or(held), false) AS sat FROM benchmark b LEFT JOIN u ON u.item_id = b.item_id GROUP BY b.item_id)"


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, weight, obtainable, sat): satisfied when all spans of any bundle are covered."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 2").alias("ue"))
    bundles = required_spans(spark, sf_dir).join(units, "doc_id").groupBy("item_id", "source").agg(F.bool_and(F.col("end") <= F.col("ue")).alias("held"))
    per = bundles.groupBy("item_id").agg(F.bool_or("held").alias("sat"))
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3 + 1).alias("weight"))
    return items.join(per, "item_id", "left").select("item_id", "weight", F.col("sat").isNotNull().alias("obtainable"), F.coalesce("sat", F.lit(False)).alias("sat"))


@query(f"{_OBLIGED} SELECT item_id, weight, obtainable, sat FROM o")
def obligation_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obligations(spark, sf_dir)


@query(f"{_OBLIGED} SELECT item_id % 4 AS family, round(sum(weight) FILTER (sat)::DOUBLE / sum(weight) FILTER (obtainable), 6) AS recall FROM o GROUP BY 1")
def weighted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where nothing can be obtained: not applicable, not zero."""
    o = obligations(spark, sf_dir)
    return o.groupBy((F.col("item_id") % 4).alias("family")).agg(F.round(F.try_divide(F.sum(F.when(F.col("sat"), F.col("weight"))), F.sum(F.when(F.col("obtainable"), F.col("weight")))), 6).alias("recall"))


@query(f"{_OBLIGED} SELECT item_id % 4 AS family, bool_or(NOT sat AND NOT obtainable AND item_id % 5 = 0) AS silent FROM o GROUP BY 1")
def silent_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Something is missing for which no acceptable reason was declared."""
    return obligations(spark, sf_dir).groupBy((F.col("item_id") % 4).alias("family")).agg(F.bool_or(~F.col("sat") & ~F.col("obtainable") & (F.col("item_id") % 5 == 0)).alias("silent"))


@query(f"WITH {_SPANS} SELECT d.source, round(sum(n_chars) FILTER (doc_id IN (SELECT doc_id FROM sp))::DOUBLE / nullif(sum(n_chars), 0), 6) AS precision FROM documents d GROUP BY d.source")
def evidence_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the returned characters that lie in useful units."""
    useful = required_spans(spark, sf_dir).select("doc_id").distinct().withColumn("useful", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(useful, "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.try_divide(F.sum(F.when(F.col("useful"), F.col("n_chars"))), F.sum("n_chars")), 6).alias("precision"))


@query(f"WITH {_SPANS}, p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) SELECT p.source, min(pos) FILTER (doc_id IN (SELECT doc_id FROM sp)) AS first_rank FROM p GROUP BY p.source")
def first_support_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of the first useful unit, null without one: one more than the units before it, so nothing is sorted."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    first = required_spans(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first"))
    before = F.count_if(F.col("doc_id") < F.col("first"))
    return docs.join(first, "source", "left").groupBy("source").agg(F.when(F.count("first") > 0, before + 1).alias("first_rank"))


@query(f"WITH {_SPANS}, r AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT r.source, k, count(DISTINCT sp.item_id) FILTER (used <= k) AS covered FROM r CROSS JOIN (VALUES (20000), (60000), (120000)) t(k) LEFT JOIN sp ON sp.doc_id = r.doc_id GROUP BY ALL")
def prefix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items supported by the units inside the first k characters of each source."""
    units = running(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), "used")
    rows = units.join(required_spans(spark, sf_dir).select("doc_id", "item_id"), "doc_id", "left")
    rows = rows.withColumn("k", F.explode(F.array(F.lit(20000), F.lit(60000), F.lit(120000))))
    return rows.groupBy("source", "k").agg(F.countDistinct(F.when(F.col("used") <= F.col("k"), F.col("item_id"))).alias("covered"))


@query("SELECT user_id AS request_id, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') = list_aggregate(list_sort(list(DISTINCT event_type) FILTER (value >= 1)), 'string_agg', ',') AS honest FROM events GROUP BY user_id")
def receipt_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that a receipt names (those of calls that took their time) are those observed."""
    own = F.sort_array(F.collect_set(F.when(F.col("latency") >= 1, F.col("source_id"))))
    return calls(spark, sf_dir).groupBy("request_id").agg((F.sort_array(F.collect_set("source_id")) == own).alias("honest"))


@query("SELECT user_id AS request_id, bool_or(event_type = 'purchase') AS mandatory_called, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'sufficient' WHEN count(*) FILTER (event_type = 'error') < count(*) / 4.0 THEN 'partial' ELSE 'insufficient' END AS evidence_status FROM events GROUP BY user_id")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, n = F.count_if(F.col("outcome") == "error"), F.count("*")
    status = F.when(errors == 0, "sufficient").when(errors < n / F.lit(4.0), "partial").otherwise("insufficient")
    return calls(spark, sf_dir).groupBy("request_id").agg(F.bool_or(F.col("source_id") == "purchase").alias("mandatory_called"), status.alias("evidence_status"))


@query("""WITH g AS (SELECT user_id AS request_id, avg(value) < 60 AS budget_ok, count(*) FILTER (event_type = 'error') < 12 AS honest, bool_or(event_type = 'purchase') AS mandatory FROM events GROUP BY 1)
SELECT request_id, concat_ws(',', CASE WHEN NOT budget_ok THEN 'budget' END, CASE WHEN NOT honest THEN 'receipt' END, CASE WHEN NOT mandatory THEN 'mandatory' END) AS failed, budget_ok AND honest AND mandatory AS safe FROM g""")
def case_score_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calls(spark, sf_dir).groupBy("request_id").agg((F.avg("latency") < 60).alias("budget_ok"), (F.count_if(F.col("outcome") == "error") < 12).alias("honest"), F.bool_or(F.col("source_id") == "purchase").alias("mandatory"))
    failed = F.concat_ws(",", *(F.when(~F.col(c), n) for c, n in (("budget_ok", "budget"), ("honest", "receipt"), ("mandatory", "mandatory"))))
    return g.select("request_id", failed.alias("failed"), (F.col("budget_ok") & F.col("honest") & F.col("mandatory")).alias("safe"))
