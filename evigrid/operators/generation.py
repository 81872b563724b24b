"""Artifacts and cases made from declared facts: filled templates, unique paths, identifiers, filler, gold cases, experiment grids."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import numeric as N
from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.tables import table

_SLOT = re.compile(r"\{([a-z_]+)\}")


def filled(template: str, slots: dict[str, Column]) -> tuple[Column, Column]:
    """A template's text, and (slot, start, end) of each value in it: half-open, from 0, in code points. A slot without a value given is refused; a null value is empty."""
    if unknown := set(_SLOT.findall(template)) - set(slots):
        raise ValueError(f"no values for slots {sorted(unknown)}")
    text, at, spans, done = F.lit(""), F.lit(0).cast("bigint"), [], 0
    for m in _SLOT.finditer(template):
        plain = template[done : m.start()]
        value = F.coalesce(slots[m[1]].cast("string"), F.lit(""))
        start = at + len(plain)
        at, done = start + F.char_length(value), m.end()
        text = F.concat(text, F.lit(plain), value)
        spans.append(F.struct(F.lit(m[1]).alias("slot"), start.alias("start"), at.alias("end")))
    empty = F.array().cast("array<struct<slot:string,start:bigint,end:bigint>>")
    return F.concat(text, F.lit(template[done:])), F.array(*spans) if spans else empty


@query("""WITH t AS (SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ' has size ' || p_size || '.' AS text, p_name, p_brand, CAST(p_size AS VARCHAR) AS s FROM part)
SELECT p_partkey, text, '[' || 5 || ',' || 5 + length(p_name) || ')[' || 9 + length(p_name) || ',' || 9 + length(p_name) + length(p_brand) || ')[' || 19 + length(p_name) + length(p_brand) || ',' || 19 + length(p_name) + length(p_brand) + length(s) || ')' AS places FROM t""")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, spans = filled("Part {name} of {brand} has size {size}.", {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")})
    places = F.array_join(F.transform(spans, lambda s: F.concat(F.lit("["), s["start"], F.lit(","), s["end"], F.lit(")"))), "")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), places.alias("places"))


@query("WITH n AS (SELECT page_id, split_part(url, '?', 1) AS p, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) AS n FROM pages) SELECT page_id, CASE WHEN n = 1 THEN p ELSE p || '-' || n END AS path FROM n")
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal paths get numbers from the second on."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "?", 1).alias("p"))
    rows = running(rows, ["p"], ["page_id"], F.lit(1), "n")
    return rows.select("page_id", F.when(F.col("n") == 1, F.col("p")).otherwise(F.concat("p", F.lit("-"), F.col("n").cast("string"))).alias("path"))


@query("SELECT conv_id AS artifact_id, 'conv/' || conv_id || coalesce(',' || string_agg('@' || turn, ',' ORDER BY turn), '') AS identifiers FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def artifact_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names an artifact: its path, then each of its versions, once and in order."""
    turns = F.array_join(F.transform(F.array_sort(F.collect_set("turn")), lambda t: F.concat(F.lit(",@"), t.cast("string"))), "")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("artifact_id")).agg(turns.alias("t")).select("artifact_id", F.concat(F.lit("conv/"), F.col("artifact_id").cast("string"), "t").alias("identifiers"))


def assertion(text: Column) -> Column:
    """struct(fact, release, environment) of fact@release[/environment]; null without an @."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^([^@]+)@([^/]+)(?:/(.+))?$", i), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("fact"), part(2).alias("release"), part(3).alias("environment")))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS fact, o_orderpriority AS release, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS environment FROM orders")
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written assertions, read back; open orders name no environment."""
    said = F.concat(F.col("o_custkey").cast("string"), F.lit("@"), "o_orderpriority", F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("/"), "o_orderstatus")).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", assertion(said).alias("a")).select("o_orderkey", "a.*")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'lang=en' ELSE 'lang=' || lang || ';translated=yes' END || CASE WHEN n_chars > 5000 THEN ';long=yes' ELSE '' END AS metadata FROM documents")
def artifact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by kind of artifact: what does not apply has no key."""
    entries = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("translated"), F.when(F.col("lang") != "en", "yes"), F.lit("long"), F.when(F.col("n_chars") > 5000, "yes")), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


#: Filler notes of each source, and what they say.
NOTES = 12
TOPICS = ("retries", "timeouts", "owners", "limits")


@query(f"""WITH n AS (SELECT source, i, md5('9|' || source || '|' || i) AS h FROM (SELECT DISTINCT source FROM documents), range({NOTES}) r(i)), u AS (SELECT source, i, CAST('0x' || left(h, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM n)
SELECT source || '/note-' || i AS path, 'About ' || ['retries', 'timeouts', 'owners', 'limits'][1 + CAST(floor(u * 4) AS INT)] || ' of ' || source || '.' AS text FROM u""")
def filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filler artifacts: each a seeded draw by its own key, so that they do not depend on how they are dealt to tasks."""
    rows = table(spark, sf_dir, "documents").select("source").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(NOTES - 1))))
    key = F.concat_ws("/note-", "source", F.col("i").cast("string"))
    u = N.uniform(F.lit(9), F.concat_ws("|", "source", F.col("i").cast("string")))
    topic = F.element_at(F.array(*(F.lit(t) for t in TOPICS)), (F.floor(u * len(TOPICS)) + 1).cast("int"))
    return rows.select(key.alias("path"), F.concat(F.lit("About "), topic, F.lit(" of "), "source", F.lit(".")).alias("text"))


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01'), g AS (SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS value, count(DISTINCT o_orderstatus) AS environments, count(DISTINCT o_orderpriority) AS obligations FROM f GROUP BY 1)
SELECT c_custkey AS case_id, value, coalesce(obligations, 0) AS obligations, CASE WHEN value IS NULL THEN 'unanswerable' WHEN environments > 1 THEN 'ambiguous' ELSE 'answerable' END AS status FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def gold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each question: the value valid at its date, what must be shown, and whether it can be answered, in one pass over the facts before that date."""
    facts = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1996-07-01'")
    g = facts.groupBy(F.col("o_custkey").alias("case_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("value"), F.countDistinct("o_orderstatus").alias("environments"), F.countDistinct("o_orderpriority").alias("obligations"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")).join(g, "case_id", "left")
    status = F.when(F.col("value").isNull(), "unanswerable").when(F.col("environments") > 1, "ambiguous").otherwise("answerable")
    return rows.select("case_id", "value", F.coalesce("obligations", F.lit(0)).alias("obligations"), status.alias("status"))


#: Stand-ins of an experiment: arms, failure profiles with their least latency of a failure, budgets.
ARMS, PROFILES, BUDGETS = ("click", "purchase"), (("none", 1e9), ("slow", 80.0)), (20, 60)


@query("""WITH g AS (SELECT * FROM (VALUES ('click'), ('purchase')) a(arm), (VALUES ('none', 1e9), ('slow', 80.0)) p(profile, least), (VALUES (20), (60)) b(budget))
SELECT arm, profile, budget, count(event_id) AS calls, count(event_id) FILTER (value < least AND value <= budget) AS answered FROM g LEFT JOIN events ON event_type = arm GROUP BY ALL""")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms under all profiles and budgets as one aggregate over the calls: the grid is a constant of a few rows."""
    cells = [(a, p, float(x), b) for a, (p, x), b in product(ARMS, PROFILES, BUDGETS)]
    grid = spark.createDataFrame(cells, "arm string, profile string, least double, budget int")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), "event_id", "value")
    ok = (F.col("value") < F.col("least")) & (F.col("value") <= F.col("budget"))
    cell = ["arm", "profile", "budget"]
    found = events.join(F.broadcast(grid), "arm").groupBy(*cell).agg(F.count("event_id").alias("calls"), F.count_if(ok).alias("answered"))
    return grid.select(*cell).join(found, cell, "left").select(*cell, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("answered", F.lit(0)).alias("answered"))
