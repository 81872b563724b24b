"""Conflicts between units of evidence, read from their texts: one term, two numbers, one subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.operators.search_index import batch_sql, build_index, search_batch
from evigrid.plans.registry import query
from evigrid.sources.scratch import shared_folder, written
from evigrid.sources.tables import hub_rows, table

# Least coverage of a unit that is compared, units compared, conflicts and dropped candidates kept; numbers, lines that only name
# places, a name in front matter, words of places, and the roles whose difference is one of intent.
COVERAGE, UNITS, CONFLICTS, CANDIDATES = 0.3, 8, 6, 6
NUMBER = r"(?<![A-Za-z0-9.])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9])"
HEADER = r"^\s*(#|//|/\*|\*|---|name:|namespace:)"
FRONT_NAME = r"(?m)^name:\s*(.+)$"
PLACE_WORDS = ("repo", "space", "skill", "queue", "md", "yaml", "java", "src", "main", "com")
ROLES = ("implemented_behavior", "intended_procedure")


def attribute_values(text: Column, terms: Column) -> Column:
    """Array of (term, value): for each of the terms the first number of the first line, headers apart, that holds both a number and the term."""

    def of(line: Column) -> Column:
        stems = F.array_distinct(F.transform(F.filter(X.words(line), lambda w: ~w.rlike("^[0-9]+$")), X.stem))
        value = F.regexp_extract(line, NUMBER, 0)
        return F.transform(F.array_intersect(stems, terms), lambda t: F.struct(t.alias("term"), value.alias("value")))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(HEADER) & x.rlike(NUMBER))
    found = F.flatten(F.transform(lines, of))
    names = F.transform(found, lambda p: p["term"])
    return F.filter(found, lambda p, i: F.array_position(names, p["term"]) == i + 1)


def identity(location: Column, text: Column, domain: tuple[str, ...]) -> Column:
    """Words that name what a unit is about: of its place's last segment and of a name in its front matter, with the acronym of a name of several words."""

    def of(name: Column) -> Column:
        ws = F.filter(X.words(name), lambda w: ~w.isin(X.STOPWORDS))
        acronym = F.when(F.size(ws) > 1, F.array(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(ws, X.stem), acronym)

    place = F.regexp_replace(F.coalesce(location, F.lit("")), "^[^:]*:", "")
    tail = F.substring_index(F.rtrim(place, F.lit("/")), "/", -1)
    front = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 300), FRONT_NAME, 1)
    return F.array_distinct(F.filter(F.concat(of(tail), of(front)), lambda w: ~w.isin(*domain, *PLACE_WORDS)))


def relation(a: Column, b: Column) -> Column:
    """How two units differ: by role, environment or version, else they contradict each other."""
    divergent = ((a["role"] == ROLES[0]) & (b["role"] == ROLES[1])) | ((a["role"] == ROLES[1]) & (b["role"] == ROLES[0]))
    versions = (a["source"] == b["source"]) & (a["artifact"] == b["artifact"]) & ~a["version"].eqNullSafe(b["version"])
    return F.when(divergent, "policy_implementation_divergence").when(a["environment"] != b["environment"], "environment_difference").when(versions, "version_difference").otherwise("contradiction")


def find_conflicts(units: DataFrame, domain: tuple[str, ...] = ()) -> DataFrame:
    """(request, n, kind, i, j, left_unit, right_unit, relation) among units (request, place, unit, coverage, terms, text, location, source, artifact, version, environment, role, meanings).

    The first UNITS units by place whose coverage suffices are compared in the order of (i, j), up to the sixth conflict. Pairs of one source and version, and
    pairs of disjoint meanings (an empty or null array of meanings is compared with all), are passed over. A pair that gives a term two values is a conflict if
    both may be about the same subject, else a candidate; six candidates are kept. n counts each kind from 1. A request's pairs are 28 at most.
    """
    place = F.row_number().over(Window.partitionBy("request").orderBy("place"))
    pool = units.where(F.col("coverage") >= COVERAGE).withColumn("i", place).where(F.col("i") <= UNITS)  # limited in each task before it is shuffled
    facts = F.struct("unit", "source", "artifact", "version", "environment", "role", "meanings", attribute_values(F.col("text"), F.col("terms")).alias("values"), identity(F.col("location"), F.col("text"), domain).alias("names"))
    rows = written(pool.select("request", "i", facts.alias("u")))
    pairs = rows.select("request", "i", F.col("u").alias("a")).join(rows.select("request", F.col("i").alias("j"), F.col("u").alias("b")), "request").where("i < j")
    a, b = F.col("a"), F.col("b")
    apart = F.coalesce((F.size(a["meanings"]) > 0) & (F.size(b["meanings"]) > 0) & ~F.arrays_overlap(a["meanings"], b["meanings"]), F.lit(False))
    clash = F.exists(a["values"], lambda x: F.exists(b["values"], lambda y: (x["term"] == y["term"]) & (x["value"] != y["value"])))
    same = (F.size(a["names"]) == 0) | (F.size(b["names"]) == 0) | F.arrays_overlap(a["names"], b["names"])
    kept = pairs.where(~((a["source"] == b["source"]) & a["version"].eqNullSafe(b["version"])) & ~apart & clash)
    kept = kept.select("request", "i", "j", a["unit"].alias("left_unit"), b["unit"].alias("right_unit"), relation(a, b).alias("relation"), F.when(same, "conflict").otherwise("candidate").alias("kind"))
    order = Window.partitionBy("request").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("kind") == "conflict"
    counted = kept.withColumn("conflicts", F.sum(own.cast("bigint")).over(order)).withColumn("n", F.when(own, F.col("conflicts")).otherwise(F.sum((~own).cast("bigint")).over(order)))
    # the scan ends with the sixth conflict: a candidate after it is not met
    return counted.where((own & (F.col("n") <= CONFLICTS)) | (~own & (F.col("conflicts") < CONFLICTS) & (F.col("n") <= CANDIDATES))).select("request", "n", "kind", "i", "j", "left_unit", "right_unit", "relation")


#: The questions of the example, each asked by three readers, and words of the domain.
QUESTIONS = (
    "Which version of the Apache License applies to licensed work?",
    "Under which general public license version is this work licensed?",
    "What does the license of the work say about warranties, conditions and its version?",
    "Licensed under which version?",
)
READERS = (("en",), ("en", "fr"), ("de", "es", "fr"))
DOMAIN = ("en", "fr", "de", "es")

TRAITS = """'hub' || doc_id % 3 AS source, doc_id % 15 AS artifact, CASE WHEN doc_id % 9 > 0 THEN doc_id // 15 % 4 END AS version, CASE doc_id % 5 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' END AS environment,
  CASE doc_id % 6 WHEN 0 THEN 'implemented_behavior' WHEN 1 THEN 'intended_procedure' ELSE 'reference' END AS role, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN [0, 1] ELSE [doc_id % 3] END AS meanings,
  CASE WHEN doc_id % 7 > 0 THEN 'repo:' || lang || CASE doc_id % 3 WHEN 0 THEN '/retry-' || source WHEN 1 THEN '/license-work/' ELSE '/' || source END END AS location"""


def traits(docs: DataFrame) -> DataFrame:
    """documents with stand-ins of what units carry: source, artifact, version, environment, role, meanings, location."""
    d = F.col("doc_id")
    location = F.concat(F.lit("repo:"), "lang", F.when(d % 3 == 0, F.concat(F.lit("/retry-"), "source")).when(d % 3 == 1, "/license-work/").otherwise(F.concat(F.lit("/"), "source")))
    return docs.select(
        "doc_id", "text",
        F.concat(F.lit("hub"), (d % 3).cast("string")).alias("source"),
        (d % 15).alias("artifact"),
        F.when(d % 9 > 0, F.floor(d / 15) % 4).alias("version"),
        F.when(d % 5 == 0, "prod").when(d % 5 == 1, "staging").alias("environment"),
        F.when(d % 6 == 0, ROLES[0]).when(d % 6 == 1, ROLES[1]).otherwise("reference").alias("role"),
        F.when(d % 4 == 0, None).when(d % 4 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array((d % 3).cast("int"))).alias("meanings"),
        F.when(d % 7 > 0, location).alias("location"),
    )


def sql_values(units: str) -> str:
    """CTE vals (request, place, term, value) over units (request, place, text, terms)."""
    number = r"(?:^|[^A-Za-z0-9.])([0-9]+(?:\.[0-9]+)?)(?:$|[^A-Za-z0-9])"
    return f"""lines AS (SELECT request, place, terms, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {units}),
numbered AS (SELECT *, regexp_extract(line, '{number}', 1) AS value FROM lines WHERE NOT regexp_matches(line, '{HEADER}') AND regexp_matches(line, '{number}')),
vals AS (SELECT request, place, term, arg_min(value, i) AS value FROM (SELECT request, place, i, value, unnest(list_intersect(list_transform(list_filter({X.sql_words("line")}, lambda w: NOT regexp_matches(w, '^[0-9]+$')), lambda w: {X.sql_stem("w")}), terms)) AS term FROM numbered) GROUP BY ALL)"""


def _sql_names(name: str) -> str:
    ws = f"list_filter({X.sql_words(name)}, lambda w: w NOT IN ({X.SQL_STOPWORDS}))"
    return f"list_concat(list_transform({ws}, lambda w: {X.sql_stem('w')}), CASE WHEN len({ws}) > 1 THEN [array_to_string(list_transform({ws}, lambda w: left(w, 1)), '')] ELSE [] END)"


def sql_conflicts(units: str, domain: tuple[str, ...] = DOMAIN) -> str:
    """CTEs up to found (request, n, kind, i, j, left_unit, right_unit, relation) over a relation of units."""
    dropped = ", ".join(f"'{w}'" for w in (*domain, *PLACE_WORDS))
    return f"""compared AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request ORDER BY place) AS i FROM {units} WHERE coverage >= {COVERAGE} QUALIFY i <= {UNITS}),
{sql_values("compared")},
named AS MATERIALIZED (SELECT *, list_filter(list_concat({_sql_names("regexp_extract(rtrim(regexp_replace(coalesce(location, ''), '^[^:]*:', ''), '/'), '[^/]*$')")}, {_sql_names(f"regexp_extract(left(coalesce(text, ''), 300), '{FRONT_NAME}', 1)")}), lambda w: w NOT IN ({dropped})) AS names FROM compared),
clash AS (SELECT DISTINCT x.request, x.place AS p, y.place AS q FROM vals x JOIN vals y ON x.request = y.request AND x.term = y.term AND x.value <> y.value),
met AS (SELECT a.request, a.i, b.i AS j, a.unit AS left_unit, b.unit AS right_unit, CASE WHEN len(a.names) = 0 OR len(b.names) = 0 OR list_has_any(a.names, b.names) THEN 'conflict' ELSE 'candidate' END AS kind,
  CASE WHEN a.role <> b.role AND a.role IN {ROLES} AND b.role IN {ROLES} THEN 'policy_implementation_divergence' WHEN a.environment <> b.environment THEN 'environment_difference'
    WHEN a.source = b.source AND a.artifact = b.artifact AND a.version IS DISTINCT FROM b.version THEN 'version_difference' ELSE 'contradiction' END AS relation
  FROM named a JOIN named b ON a.request = b.request AND a.i < b.i JOIN clash c ON c.request = a.request AND c.p = a.place AND c.q = b.place
  WHERE NOT (a.source = b.source AND a.version IS NOT DISTINCT FROM b.version) AND NOT coalesce(len(a.meanings) > 0 AND len(b.meanings) > 0 AND NOT list_has_any(a.meanings, b.meanings), false)),
counted AS (SELECT *, count(*) FILTER (kind = 'conflict') OVER w AS conflicts, count(*) FILTER (kind = 'candidate') OVER w AS candidates FROM met WINDOW w AS (PARTITION BY request ORDER BY i, j)),
found AS (SELECT request, CASE kind WHEN 'conflict' THEN conflicts ELSE candidates END AS n, kind, i, j, left_unit, right_unit, relation FROM counted WHERE (kind = 'conflict' AND conflicts <= {CONFLICTS}) OR (kind = 'candidate' AND conflicts < {CONFLICTS} AND candidates <= {CANDIDATES}))"""


#: More units than are compared, so that coverage decides which.
HITS = 20
_ASKED = ", ".join(f"({len(READERS) * i + r}, {r}, '{q}')" for i, q in enumerate(QUESTIONS) for r in range(len(READERS)))
_UNITS = f"""asked AS (SELECT * FROM (VALUES {_ASKED}) v(question, reader, text)), {batch_sql("asked")},
units AS (SELECT question AS request, row_number() OVER (PARTITION BY question ORDER BY score DESC, artifact_id) AS place, artifact_id AS unit, coverage, terms, d.* FROM s JOIN (SELECT question, list(term) AS terms FROM q GROUP BY question) USING (question)
  JOIN (SELECT doc_id, text, {TRAITS} FROM documents) d ON d.doc_id = artifact_id QUALIFY place <= {HITS})"""


def conflict_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the example's requests: the best hits of an index, with the few texts that these hits need."""
    rows = [(len(READERS) * i + r, list(groups), q) for i, q in enumerate(QUESTIONS) for r, groups in enumerate(READERS)]
    asked = spark.createDataFrame(rows, "question long, groups array<string>, text string")
    hits = search_batch(build_index(hub_rows(spark, sf_dir), shared_folder(spark)), asked, HITS)
    terms = asked.select(F.col("question").alias("request"), X.content_terms(F.col("text")).alias("terms"))
    found = hits.select(F.col("question").alias("request"), F.col("rank").alias("place"), F.col("artifact_id").alias("unit"), "coverage").join(F.broadcast(terms), "request")
    return found.join(traits(table(spark, sf_dir, "documents")), F.col("unit") == F.col("doc_id"))


@query(f"WITH {_UNITS}, {sql_conflicts('units')} SELECT * FROM found")
def text_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts and dropped candidates among what an index finds for each request, read from the texts."""
    return find_conflicts(conflict_units(spark, sf_dir), DOMAIN)


@query(f"WITH {_UNITS}, {sql_values('units')} SELECT request, units.unit, term, value FROM vals JOIN units USING (request, place)")
def term_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each unit says of each term of its request: the first number of a line with it."""
    rows = conflict_units(spark, sf_dir)
    return rows.select("request", "unit", F.inline(attribute_values(F.col("text"), F.col("terms"))))
