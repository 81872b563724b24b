"""Intervals against intervals: an equi-join on bins instead of a comparison of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.containment import occurrences
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import table


def _bins(start: Column, end: Column, size: int) -> Column:
    """Numbers of the bins that a half-open interval touches; an empty one touches its start's bin."""
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end - 1) / size))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """All pairs of overlapping half-open intervals (start, end) with equal keys; right's columns are start_2 and end_2, others have names of their own.

    Both sides go to the bins they touch and meet there; a pair that shares several bins is kept in the one where the later of the two begins. bin_size
    should be near the intervals' length: shorter bins mean more copies of an interval, longer ones more pairs to look at.
    """
    a = left.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), bin_size)))
    b = right.withColumnsRenamed({"start": "start_2", "end": "end_2"}).withColumn("_bin", F.explode(_bins(F.col("start_2"), F.col("end_2"), bin_size)))
    met = a.join(b, [*keys, "_bin"]).where((F.col("start") < F.col("end_2")) & (F.col("start_2") < F.col("end")))
    return met.where(F.col("_bin") == F.floor(F.greatest("start", "start_2") / bin_size)).drop("_bin")


#: Characters of a unit.
UNIT = 200


def units_of(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, start, end): the text of documents in units of UNIT characters, the last one shorter."""
    return _units(docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n")))


def _units(sizes: DataFrame) -> DataFrame:
    """The units of documents (doc_id, n) of n characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(UNIT))
    rows = sizes.where("n > 0").select("doc_id", "n", F.explode(starts).alias("start"))
    return rows.select("doc_id", F.floor(F.col("start") / UNIT).alias("unit"), F.col("start").cast("bigint").alias("start"), F.least(F.col("start") + UNIT, "n").cast("bigint").alias("end"))


def item_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, start, end): every occurrence of every benchmark item in every document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("string_id"), F.col("text").alias("string"))
    found = occurrences(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    sizes = items.select(F.col("string_id"), F.length("string").alias("n"))
    return found.join(sizes, "string_id").select(F.col("string_id").alias("item_id"), F.col("text_id").alias("doc_id"), "start", (F.col("start") + F.col("n")).cast("bigint").alias("end"))


def units_met(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of documents (.., doc_id, start, end) with the units (unit, start_2, end_2) that they overlap. Only documents with spans are cut into units."""
    sizes = docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"))
    return overlap_join(spans, _units(sizes.join(spans.select("doc_id").distinct(), "doc_id", "left_semi")), ["doc_id"], UNIT)


_EVERY = f"""pairs AS (SELECT item_id, doc_id, d.text, b.text AS item FROM documents d, benchmark b WHERE contains(d.text, b.text)),
sp AS (SELECT item_id, doc_id, i AS s, i + length(item) AS e FROM (SELECT *, unnest(range(length(text) - length(item) + 1)) AS i FROM pairs) WHERE text[i + 1:i + length(item)] = item),
us AS (SELECT doc_id, i // {UNIT} AS unit, i AS us, least(i + {UNIT}, length(text)) AS ue FROM (SELECT doc_id, text, unnest(range(0, length(text), {UNIT})) AS i FROM documents))"""


@query(f'WITH {_EVERY} SELECT item_id, doc_id, s AS start, e AS "end" FROM sp')
def every_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_spans(spark, sf_dir)


@query(f"WITH {_EVERY} SELECT item_id, sp.doc_id, s AS start, unit, us <= s AND e <= ue AS covered FROM sp JOIN us ON us.doc_id = sp.doc_id AND us < e AND s < ue")
def span_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of every item with the units that it overlaps, and whether a unit covers it whole."""
    met = units_met(written(item_spans(spark, sf_dir)), table(spark, sf_dir, "documents"))
    return met.select("item_id", "doc_id", "start", "unit", ((F.col("start_2") <= F.col("start")) & (F.col("end") <= F.col("end_2"))).alias("covered"))


@query(f"""WITH {_EVERY}, c AS (SELECT item_id, sp.doc_id, s, bool_or(unit % 4 <> 3) AS shown FROM sp JOIN us ON us.doc_id = sp.doc_id AND us < e AND s < ue GROUP BY ALL),
b AS (SELECT item_id, source, bool_and(shown) AS held FROM c JOIN documents USING (doc_id) GROUP BY ALL) SELECT i.item_id, coalesce(bool_or(held), false) AS satisfied, count(held) AS bundles FROM benchmark i LEFT JOIN b ON b.item_id = i.item_id GROUP BY i.item_id""")
def obligation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an item is met: all its spans in some bundle (a source) overlap a unit that was shown (all but each fourth)."""
    docs = table(spark, sf_dir, "documents")
    shown = units_met(written(item_spans(spark, sf_dir)), docs).groupBy("item_id", "doc_id", "start").agg(F.bool_or(F.col("unit") % 4 != 3).alias("shown"))
    bundles = shown.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.bool_and("shown").alias("held"))
    per = bundles.groupBy("item_id").agg(F.bool_or("held").alias("any_held"), F.count("*").alias("n"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(per, "item_id", "left").select("item_id", F.coalesce("any_held", F.lit(False)).alias("satisfied"), F.coalesce("n", F.lit(0)).alias("bundles"))
