"""Names in questions and what they denote: longest matches, visibility by name, and narrowing by the context's domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import table

#: Words of a label, at most: a fixed value.
LABEL_WORDS = 4


def matched_labels(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """(question, pos, size, label) of questions (question, text) against labels (label: words joined by blanks): longest matches from left to right that don't overlap.

    All runs of up to four words meet the labels in one join; the runs that are labels are then gone through in order, a few for each question.
    """
    words = questions.select("question", X.words(F.col("text")).alias("w"))
    sizes = F.sequence(F.lit(1), F.lit(LABEL_WORDS))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.filter(sizes, lambda n: i + n - 1 <= F.size("w")), lambda n: F.struct(i.alias("pos"), n.alias("size"), F.array_join(F.slice("w", i, n), " ").alias("label")))))
    known = written(labels.select("label").distinct())  # its size is known, and a semi-join never sends the runs to all
    met = words.where(F.size("w") > 0).select("question", F.inline(runs)).join(known, "label", "left_semi")
    each = met.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("pos", (-F.col("size")).alias("back"), "label"))).alias("m"))
    none = F.expr("filter(m, x -> false)")

    def take(state: Column, x: Column) -> Column:
        free = x["pos"] >= state["next"]
        return F.struct(F.when(free, x["pos"] - x["back"]).otherwise(state["next"]).alias("next"), F.when(free, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate("m", F.struct(F.lit(1).alias("next"), none.alias("kept")), take)["kept"]
    return each.select("question", F.explode(kept).alias("x")).select("question", "x.pos", (-F.col("x.back")).alias("size"), "x.label")


def resolved(questions: DataFrame, denotes: DataFrame) -> DataFrame:
    """(question, pos, label, candidates, chosen, origin) of questions (question, groups, text, scope) by names denotes (label, entity, domains, groups).

    A name counts for a reader whose groups meet its own (null or no groups: for nobody). Several visible meanings are narrowed to the one whose domain the scope
    or the question names, if there is exactly one (origin request_context); else all of them are chosen and the name is ambiguous (origin denotes, several
    chosen). A name without a visible meaning has origin none. Arrays are sorted. Nothing is chosen by a score.
    """
    spans = matched_labels(questions, denotes)
    asked = questions.select("question", F.col("groups").alias("own"), F.array_distinct(F.concat(X.words(F.col("text")), X.words(F.coalesce("scope", F.lit(""))))).alias("context"))
    visible = F.coalesce(F.arrays_overlap("groups", "own"), F.lit(False))
    named = F.arrays_overlap("domains", "context")
    met = spans.join(asked, "question").join(denotes, "label")
    meanings = met.groupBy("question", "pos", "label").agg(
        F.array_sort(F.collect_set(F.when(visible, F.col("entity")))).alias("candidates"),
        F.array_sort(F.collect_set(F.when(visible & named, F.col("entity")))).alias("narrowed"),
    )
    one = (F.size("candidates") > 1) & (F.size("narrowed") == 1)
    origin = F.when(F.size("candidates") == 0, "none").when(one, "request_context").otherwise("denotes")
    return meanings.select("question", "pos", "label", "candidates", F.when(one, F.col("narrowed")).otherwise(F.col("candidates")).alias("chosen"), origin.alias("origin"))


def label_only(spans: DataFrame, denotes: DataFrame) -> DataFrame:
    """(question, pos, label, entity): the control without namespaces: of a label's names (label, entity, ord) the first one wins, whoever asks."""
    first = denotes.groupBy("label").agg(F.min_by("entity", F.struct("ord", "entity")).alias("entity"))
    return spans.join(first, "label").select("question", "pos", "label", "entity")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in a domain (the type) as entities; in one domain the name's second word is a name, too. Two groups of readers see most of them."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k"))
    last = F.element_at(F.split("p_name", " "), -1)
    labels = F.when(F.col("p_type") == "PROMO", F.array("p_name", last)).otherwise(F.array("p_name"))
    groups = F.filter(F.array(F.when(F.col("k") % 4 > 0, "g0"), F.when(F.col("k") % 3 > 0, "g1")), lambda g: g.isNotNull())
    return p.select(F.explode(labels).alias("label"), F.concat(F.lit("part-"), F.col("k").cast("string")).alias("entity"), F.array(F.lower("p_type")).alias("domains"), groups.alias("groups"), F.col("k").alias("ord"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each line of an order, on its part; some name a domain, some have a scope."""
    i = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    number = F.col("l_orderkey") * 10 + i
    rows = lines.groupBy(number.alias("question")).agg(F.min(F.struct("p_partkey", "p_name", "p_type")).alias("p"))
    q = F.col("question")
    text = F.concat(F.lit("Which "), "p.p_name", F.lit(" or "), F.element_at(F.split("p.p_name", " "), -1), F.when(q % 3 == 0, F.concat(F.lit(" in "), F.lower("p.p_type"))).otherwise(""), F.lit(" fits?"))
    return rows.select("question", F.array(F.concat(F.lit("g"), (q % 2).cast("string"))).alias("groups"), text.alias("text"), F.when(q % 5 == 0, F.lower("p.p_type")).alias("scope"))


_ASKED = """n AS (SELECT p_name, p_type, min(p_partkey) AS k FROM part GROUP BY ALL),
d AS (SELECT label, 'part-' || k AS entity, lower(p_type) AS domain, k, k % 4 > 0 AS g0, k % 3 > 0 AS g1 FROM (SELECT *, p_name AS label FROM n UNION ALL SELECT *, split_part(p_name, ' ', 2) FROM n WHERE p_type = 'PROMO')),
l AS (SELECT l_orderkey * 10 + l_linenumber AS question, arg_min(p_name, p_partkey) AS name, lower(arg_min(p_type, p_partkey)) AS type FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
q AS (SELECT question, name, type, question % 2 AS g, string_split(lower('which ' || name || ' or ' || split_part(name, ' ', 2) || CASE WHEN question % 3 = 0 THEN ' in ' || type ELSE '' END || ' fits'), ' ') AS w, CASE WHEN question % 5 = 0 THEN type END AS scope FROM l),
m AS (SELECT question, 2 AS pos, name AS label FROM q UNION ALL SELECT question, 5, split_part(name, ' ', 2) FROM q),
x AS (SELECT m.question, pos, m.label, list_sort(list(DISTINCT entity) FILTER (CASE g WHEN 0 THEN g0 ELSE g1 END)) AS c, list_sort(list(DISTINCT entity) FILTER (CASE g WHEN 0 THEN g0 ELSE g1 END AND (list_contains(w, domain) OR domain IS NOT DISTINCT FROM scope))) AS narrow FROM m JOIN q USING (question) JOIN d ON d.label = m.label GROUP BY ALL)"""


@query(f"WITH {_ASKED} SELECT question, CAST(pos AS INT) AS pos, label, coalesce(array_to_string(c, ','), '') AS candidates, coalesce(array_to_string(CASE WHEN len(c) > 1 AND len(narrow) = 1 THEN narrow ELSE c END, ','), '') AS chosen, CASE WHEN coalesce(len(c), 0) = 0 THEN 'none' WHEN len(c) > 1 AND len(narrow) = 1 THEN 'request_context' ELSE 'denotes' END AS origin FROM x")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name in every question, with its visible meanings and what is chosen of them."""
    rows = resolved(_questions(spark, sf_dir), _names(spark, sf_dir))
    return rows.select("question", "pos", "label", F.array_join("candidates", ",").alias("candidates"), F.array_join("chosen", ",").alias("chosen"), "origin")


@query(f"WITH {_ASKED} SELECT question, CAST(pos AS INT) AS pos, label, entity FROM m JOIN (SELECT label, arg_min(entity, k) AS entity FROM d GROUP BY label) USING (label)", name="label_only")
def label_only_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name in every question by the first assertion of its label."""
    names = _names(spark, sf_dir)
    return label_only(matched_labels(_questions(spark, sf_dir), names), names)
