"""Excerpts of texts for a question: lines that answer or assert, their neighbours, and what qualifies them, within a number of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.plans.registry import query
from evigrid.sources.tables import table

# Characters of an excerpt, of the compact one (also of its beginning), and of the text's beginning where no line is taken.
MOST, COMPACT, BEGINNING = 1200, 350, 400

# What assigns a value to a name, and what qualifies a line.
ASSIGNMENT = r"""(?:^|[\s,{(])([A-Za-z_][A-Za-z0-9_.-]{1,60})\s*(?:=|:)\s*["']?[-\w.]"""
QUALIFIER = r"(?i)\b(environment|env|prod|production|staging|experiment|release|version|branch)\b|\bR\d{2,}\b|^\s*#"


def _lines(texts: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(artifact_id, i, start, size, qualifies, chosen): places of lines. Only lengths and marks are shuffled, not the texts."""
    line = F.col("line")
    filled = line.rlike("[^ \t\r\f]")
    asked = F.arrays_overlap(F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, terms)).cast("array<string>"))
    marks = texts.select("artifact_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select(
        "artifact_id", "i", F.length(line).alias("size"), filled.alias("filled"), line.rlike(QUALIFIER).alias("qualifies"), ((filled & asked) | (line.rlike(ASSIGNMENT) & line.rlike("[0-9]"))).alias("hit")
    )
    whole = Window.partitionBy("artifact_id")
    order = whole.orderBy("i")
    near = marks.select("*", F.sum(F.col("size").cast("bigint") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.bool_or("hit").over(order.rowsBetween(-1, 1)).alias("near"))
    some = F.bool_or(F.col("near") & F.col("filled")).over(whole)
    chosen = F.col("filled") & (F.col("near") | (F.col("qualifies") & some))
    return near.select("artifact_id", "i", (F.col("upto") - F.col("size") - 1).alias("start"), "size", "qualifies", chosen.alias("chosen"))


def excerpts(texts: DataFrame, terms: tuple[str, ...], most: int = MOST, beginning: int = BEGINNING, qualifiers_first: bool = False) -> DataFrame:
    """(artifact_id, start, end): the taken lines of texts (artifact_id, text), half-open in code points from 0. Null texts have none; ids are unique.

    Chosen are lines with a term or an assertion, the lines beside them, and, where there are any, all qualifying lines; blank lines
    never. Whole lines are taken in order until one does not fit. With qualifiers_first qualifying lines go first and a line that does
    not fit is passed over. Where none is taken, the text's beginning is.
    """
    lines = _lines(texts, terms).where("chosen").withColumn("cost", F.col("size") + 1)
    if qualifiers_first:
        # a line that fits in no excerpt never gets into the array; what is taken is `most` / 2 lines at most
        order = F.struct((~F.col("qualifies")).alias("later"), "i", "cost", "start", "size")
        own = lines.where(F.col("cost") <= most).groupBy("artifact_id").agg(F.array_sort(F.collect_list(order)).alias("own"))
        none = F.expr("filter(own, x -> false)")

        def take(a: Column, x: Column) -> Column:
            fits = a["used"] + x["cost"] <= most
            return F.struct(F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["kept"], x)).otherwise(a["kept"]).alias("kept"))

        kept = F.aggregate("own", F.struct(F.lit(0).alias("used"), none.alias("kept")), take)["kept"]
        taken = own.select("artifact_id", F.explode(kept).alias("x")).select("artifact_id", "x.start", "x.size")
    else:
        used = F.sum("cost").over(Window.partitionBy("artifact_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        taken = lines.withColumn("used", used).where(F.col("used") <= most).select("artifact_id", "start", "size")
    rest = texts.where("text IS NOT NULL").join(taken.select("artifact_id").distinct(), "artifact_id", "left_anti")
    first = rest.select("artifact_id", F.lit(0).cast("bigint").alias("start"), F.least(F.length("text"), F.lit(beginning)).cast("bigint").alias("end"))
    return taken.select("artifact_id", "start", (F.col("start") + F.col("size")).alias("end")).unionByName(first)


#: A stand-in of a question's terms.
TERMS = ("leaux", "erst", "nicht", "license")

_CHOSEN = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, length(line) AS size, regexp_matches(line, '[^ \t\r\f]') AS filled, regexp_matches(line, '{QUALIFIER}') AS qualifies,
list_has_any(regexp_extract_all(lower(line), '[a-z0-9]+'), [{", ".join(f"'{t}'" for t in TERMS)}]) AND regexp_matches(line, '[^ \t\r\f]') OR (regexp_matches(line, '{ASSIGNMENT.replace("'", "''")}') AND regexp_matches(line, '[0-9]')) AS hit FROM l),
n AS (SELECT *, sum(size + 1) OVER (PARTITION BY doc_id ORDER BY i) - size - 1 AS start, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS near FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, start, size, qualifies FROM (SELECT *, bool_or(near AND filled) OVER (PARTITION BY doc_id) AS any_hit FROM n) WHERE filled AND (near OR (qualifies AND any_hit)))"""
_TAKEN = "SELECT doc_id AS artifact_id, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS end FROM k UNION ALL SELECT doc_id, 0, least(length(text), {}) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM k)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "text")


@query(f"WITH {_CHOSEN}, k AS (SELECT doc_id, start, size FROM (SELECT *, sum(size + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM c) WHERE used <= {MOST}) {_TAKEN.format(BEGINNING)}")
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excerpts(_texts(spark, sf_dir), TERMS)


@query(f"""WITH RECURSIVE {_CHOSEN}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT qualifies, i) AS r FROM c WHERE size < {COMPACT}),
f AS (SELECT doc_id, r, start, size, size + 1 AS used, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, o.start, o.size, CASE WHEN used + o.size + 1 <= {COMPACT} THEN used + o.size + 1 ELSE used END, used + o.size + 1 <= {COMPACT} FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1),
k AS (SELECT doc_id, start, size FROM f WHERE kept) {_TAKEN.format(COMPACT)}""")
def compact_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excerpts(_texts(spark, sf_dir), TERMS, COMPACT, COMPACT, qualifiers_first=True)
