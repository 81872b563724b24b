"""Scans for leaks, broken references and inconsistencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.scoring import _SPANS, required_spans
from evigrid.plans.registry import query
from evigrid.sources.tables import table


@query(f"WITH {_SPANS} SELECT item_id, doc_id FROM sp WHERE source NOT IN (SELECT source FROM sp s2 WHERE s2.item_id = sp.item_id AND lang = 'en')")
def leak_visible_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks in sources where the reader's language does not show the same text anyway."""
    s = required_spans(spark, sf_dir)
    visible = s.where("lang = 'en'").select("item_id", "source").distinct()
    return s.join(visible, ["item_id", "source"], "left_anti").select("item_id", "doc_id")


@query(f"WITH {_SPANS} SELECT b.item_id FROM benchmark b WHERE b.item_id NOT IN (SELECT item_id FROM sp)")
def unasserted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id").join(required_spans(spark, sf_dir).select("item_id"), "item_id", "left_anti")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '(^|[^\\w./-])https?://[\\w.]*example\\.net(/|$)') ")
def identifier_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole identifiers only: what stands before and after is no part of a name."""
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"(?<![\w./-])https?://[\w.]*example\.net(?![^/])")).select("page_id")


@query("SELECT doc_id, count(DISTINCT trim(l)) AS distinctive FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 20 GROUP BY doc_id")
def distinctive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 20))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("distinctive")).where("distinctive > 0")


@query("SELECT * FROM (SELECT doc_id, n_chars + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS declared, length(text) AS actual FROM documents) WHERE declared <> actual")
def span_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose declared end is not their text's; one in 97 is declared wrongly."""
    declared = F.col("n_chars") + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", declared.alias("declared"), F.length("text").cast("bigint").alias("actual")).where("declared <> actual")


@query("SELECT source, acl FROM (SELECT source, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS acl FROM documents GROUP BY source) WHERE acl <> CASE WHEN source LIKE '%5' THEN 'de,en' ELSE 'de,en,es,fr' END")
def acl_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose rendered acl is not the authored one: all four languages, and in some places two."""
    acl = F.array_join(F.sort_array(F.collect_set("lang")), ",")
    authored = F.when(F.col("source").endswith("5"), "de,en").otherwise("de,en,es,fr")
    return table(spark, sf_dir, "documents").groupBy("source").agg(acl.alias("acl")).where(F.col("acl") != authored)


@query("SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '[0-9]+$', '') AS path, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that several pages have, a trailing number apart."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "[0-9]+$", "")
    return table(spark, sf_dir, "pages").groupBy(path.alias("path")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS ref, CASE WHEN d.doc_id IS NULL THEN 'dangling' ELSE 'unreferenced' END AS problem FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, and targets that nothing refers to."""
    refs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target"))
    both = refs.join(known, F.col("ref") == F.col("target"), "full_outer").where("ref IS NULL OR target IS NULL")
    return both.select(F.coalesce("ref", "target").alias("ref"), F.when(F.col("target").isNull(), "dangling").otherwise("unreferenced").alias("problem"))


@query("SELECT coalesce(a.k, b.k) AS key, a.v AS left_value, b.v AS right_value FROM (SELECT n_name AS k, n_regionkey AS v FROM nation) a FULL JOIN (SELECT n_name AS k, n_nationkey // 5 AS v FROM nation) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("left_value"))
    b = n.select(F.col("n_name").alias("key"), F.expr("CAST(n_nationkey div 5 AS INT)").alias("right_value"))
    return a.join(b, "key", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select("key", "left_value", "right_value")


@query("WITH v AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) SELECT a.w AS inner_word, b.w AS outer_word FROM v a JOIN v b ON a.w <> b.w AND contains(b.w, a.w)")
def vocabulary_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lie inside others: all parts of each word are looked up, so that nothing is compared with everything."""
    v = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("w")).distinct()
    n = F.length("w")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("w"), i, k))))
    inner = v.where(n > 0).select(F.col("w").alias("outer_word"), F.explode(F.array_distinct(parts)).alias("inner_word"))
    return inner.join(v.select(F.col("w").alias("inner_word")), "inner_word").where("inner_word <> outer_word").select("inner_word", "outer_word")
