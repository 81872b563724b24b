"""Packing with reserved conflict witnesses, leftover units and an order by model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.operators.conflicts import DOMAIN, QUESTIONS, TRAITS, find_conflicts, sql_conflicts, traits
from evigrid.operators.search import _scored, cte
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import table

#: Candidates of a request, at most: the limit that all configurations share. It bounds the arrays below.
CANDIDATES = 60
RESERVED, RANKED, PROMOTED, EXTRA = range(4)


def list_cost(units: Column, cost: Column, source: Column, gap: int) -> Column:
    """Cost of a list of places: its units, and gap wherever two neighbours are of different sources."""
    changes = F.filter(F.sequence(F.lit(2), F.size(units)), lambda k: F.element_at(source, F.element_at(units, k)) != F.element_at(source, F.element_at(units, k - 1)))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda a, i: a + F.element_at(cost, i)) + F.when(F.size(units) > 1, F.size(changes) * gap).otherwise(0)


def _first_fitting(drops: Column, most: Column, left: Column, budget: int, cost_of) -> Column:
    """left without the shortest beginning of drops that makes it fit, of up to `most` drops; null if none does."""
    tries = F.transform(F.sequence(F.lit(0), most), lambda k: F.array_except(left, F.slice(drops, F.lit(1), k)))
    return F.get(F.filter(tries, lambda x: cost_of(x) <= budget), F.lit(0))


def packed(units: DataFrame, pairs: DataFrame, budget: int, gap: int, reserve: bool = True) -> DataFrame:
    """One row a request: chosen (units in final order), flagged (ordinals of the pairs kept whole), rules (units that the rules alone
    packed), used, truncated (a relevant unit of the best coverage is missing) and omitted (missing witnesses of pairs).

    units: (request, unit, place: from 1 over ranked and then extra ones, extra, cost, source, relevant, coverage, score), CANDIDATES a
    request at most, places without gaps. pairs: (request, ord, i, j: two places, promoted). Both witnesses of a reserved pair go in, or neither by
    reservation; then ranked units in order, skipping what does not fit; then promoted pairs and extra units into what is left. The final order
    is by place; while it costs too much, the last unit goes, one that the rules did not pack first. Scores reorder what is packed (a unit without
    one goes last); where the new order costs too much, units from outside the rules go, and if that does not help the old order stays.
    """
    own = F.array_sort(F.collect_list(F.struct("place", "unit", "extra", "cost", "source", "relevant", "coverage", "score")))
    rows = units.groupBy("request").agg(own.alias("u"))
    both = pairs.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "j", "promoted"))).alias("p"))
    empty = F.array().cast("array<struct<ord:int,i:int,j:int,promoted:boolean>>")
    rows = rows.join(both, "request", "left").withColumn("p", F.coalesce("p", empty))
    rows = rows.select("request", "u", "p", *(F.col(f"u.{f}").alias(f) for f in ("cost", "source", "score")), F.array_max("u.coverage").alias("top"))

    def step(kind: int, i: Column, j: Column, n: Column, needed: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), n.cast("int").alias("n"), needed.alias("needed"))

    def of_pairs(kind: int, which) -> Column:
        return F.transform(F.filter("p", which), lambda x: step(kind, x["i"], x["j"], x["ord"], F.lit(False)))

    def of_units(kind: int, which) -> Column:
        needed = lambda x: x["relevant"] & (x["coverage"] >= F.col("top") - 1e-9)
        return F.transform(F.filter("u", which), lambda x: step(kind, x["place"], F.lit(None), F.lit(None), needed(x) if kind == RANKED else F.lit(False)))

    steps = [of_units(RANKED, lambda x: ~x["extra"]), of_units(EXTRA, lambda x: x["extra"])]
    if reserve:
        steps = [of_pairs(RESERVED, lambda x: ~x["promoted"]), steps[0], of_pairs(PROMOTED, lambda x: x["promoted"]), steps[1]]

    def with_unit(used: Column, taken: Column, i: Column) -> tuple[Column, Column]:
        held = F.array_contains(taken, i)
        apart = F.when((F.size(taken) > 0) & (F.element_at("source", F.element_at(taken, -1)) != F.element_at("source", i)), gap).otherwise(0)
        return F.when(held, used).otherwise(used + F.element_at("cost", i) + apart), F.when(held, taken).otherwise(F.array_append(taken, i))

    def fold(acc: Column, s: Column) -> Column:
        used, taken = with_unit(acc["used"], acc["taken"], s["i"])
        second = s["j"].isNotNull()
        used2, taken2 = with_unit(used, taken, F.coalesce(s["j"], s["i"]))
        fits = (used <= budget) & (used2 <= budget)
        now = F.when(fits, taken2).otherwise(acc["taken"])
        return F.struct(
            F.when(fits, used2).otherwise(acc["used"]).alias("used"),
            now.alias("taken"),
            F.when(s["kind"] <= RANKED, now).otherwise(acc["rules"]).alias("rules"),
            F.when(fits & second, F.array_append(acc["flagged"], s["n"])).otherwise(acc["flagged"]).alias("flagged"),
            (acc["missed"] | (~fits & s["needed"])).alias("missed"),
        )

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("taken"), none.alias("rules"), none.alias("flagged"), F.lit(False).alias("missed"))
    rows = rows.withColumn("f", F.aggregate(F.concat(*steps), start, fold))

    def cost_of(x: Column) -> Column:
        return list_cost(x, F.col("cost"), F.col("source"), gap)

    taken, rules = F.array_sort("f.taken"), F.col("f.rules")
    rows = rows.withColumns({"t": taken, "drops": F.concat(F.reverse(F.array_except(taken, rules)), F.reverse(F.array_intersect(taken, rules)))})
    rows = rows.withColumn("fitting", _first_fitting(F.col("drops"), F.size("drops"), F.col("t"), budget, cost_of))
    ordered = F.transform(F.array_sort(F.transform("fitting", lambda i: F.struct((-F.coalesce(F.element_at("score", i), F.lit(-1.0))).alias("s"), i.alias("i")))), lambda x: x["i"])
    rows = rows.withColumn("ordered", ordered).withColumn("outside", F.reverse(F.array_except("ordered", rules)))
    rows = rows.withColumn("final", F.coalesce(_first_fitting(F.col("outside"), F.size("outside"), F.col("ordered"), budget, cost_of), "fitting"))

    def held(x: Column) -> Column:
        return F.array_contains("fitting", x["i"]) & F.array_contains("fitting", x["j"])

    kept = F.filter("p", lambda x: held(x) & (F.array_contains("f.flagged", x["ord"]) if reserve else ~x["promoted"]))
    missing = F.filter("p", lambda x: F.lit(reserve) & ~F.exists(kept, lambda y: y["ord"] == x["ord"]))
    omitted = F.array_distinct(F.filter(F.flatten(F.transform(missing, lambda x: F.array(x["i"], x["j"]))), lambda i: ~F.array_contains("final", i)))

    def named(x: Column) -> Column:
        return F.transform(x, lambda i: F.element_at("u", i)["unit"])

    lost = F.exists(F.array_except("t", "fitting"), lambda i: F.element_at("u", i)["relevant"])
    return rows.select(
        "request",
        named(F.col("final")).alias("chosen"),
        F.transform(kept, lambda x: x["ord"]).alias("flagged"),
        named(F.array_sort(rules)).alias("rules"),
        cost_of(F.col("final")).alias("used"),
        (F.col("f.missed") | lost | (F.size(missing) > 0)).alias("truncated"),
        named(omitted).alias("omitted"),
        F.array_sort(named(F.array_except(rules, "final"))).alias("violations"),
    )


#: The example's budget and the price of a change of source.
BUDGET, GAP = 1500, 20


def _example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as units of their customers' requests; same priority and different status is a conflict."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("unit"), "o_totalprice", F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("value"))
    o = o.withColumn("extra", F.col("unit") % 4 == 0)
    best = Window.partitionBy("request").orderBy("extra", F.desc("o_totalprice"), "unit")
    o = o.withColumn("place", F.row_number().over(best)).where(F.col("place") <= CANDIDATES)
    coverage = (F.col("unit") % 10).cast("double") / 10
    units = o.select("request", "unit", "place", "extra", (F.lit(100) + F.col("unit") % 700).cast("bigint").alias("cost"), "source", "value", (coverage >= 0.4).alias("relevant"), coverage.alias("coverage"), F.when(F.col("unit") % 5 != 0, (F.col("unit") % 97).cast("double")).alias("score"))
    first = units.where("NOT extra AND place <= 8").select("request", "place", "source", "value")
    second = first.select("request", F.col("place").alias("j"), "source", F.col("value").alias("other"))
    found = first.withColumnRenamed("place", "i").join(second, ["request", "source"]).where("i < j AND value <> other")
    pairs = found.withColumn("ord", F.row_number().over(Window.partitionBy("request").orderBy("i", "j"))).where("ord <= 6")
    return packed(units.drop("value"), pairs.select("request", "ord", "i", "j", (F.col("ord") > 3).alias("promoted")), BUDGET, GAP)


_COST = "(coalesce(list_sum(list_transform({x}, lambda i: cs[i])), 0) + {gap} * len(list_filter(range(2, len({x}) + 1), lambda k: ss[{x}[k]] <> ss[{x}[k - 1]])))"


def _sql_cost(x: str) -> str:
    return _COST.replace("{x}", x).replace("{gap}", str(GAP))


def _sql_with(used: str, taken: str, i: str) -> tuple[str, str]:
    held = f"list_contains({taken}, {i})"
    return f"CASE WHEN {held} THEN {used} ELSE {used} + cs[{i}] + CASE WHEN len({taken}) > 0 AND ss[{taken}[-1]] <> ss[{i}] THEN {GAP} ELSE 0 END END", f"CASE WHEN {held} THEN {taken} ELSE list_append({taken}, {i}) END"


_ONE = _sql_with("f.used", "f.taken", "s.i")
_TWO = _sql_with("used1", "taken1", "j2")
_UNITS = f"""u AS (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY extra, o_totalprice DESC, unit) AS INT) AS place, coverage >= 0.4 AS relevant FROM (
  SELECT o_custkey AS request, o_orderkey AS unit, o_totalprice, o_orderpriority AS source, o_orderstatus AS value, o_orderkey % 4 = 0 AS extra, CAST(100 + o_orderkey % 700 AS BIGINT) AS cost, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS coverage, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) END AS score FROM orders) QUALIFY place <= {CANDIDATES}),
p AS (SELECT a.request, CAST(row_number() OVER (PARTITION BY a.request ORDER BY a.place, b.place) AS INT) AS ord, ord > 3 AS promoted, a.place AS i, b.place AS j FROM u a JOIN u b ON a.request = b.request AND a.source = b.source AND a.place < b.place AND a.value <> b.value AND NOT a.extra AND NOT b.extra AND a.place <= 8 AND b.place <= 8 QUALIFY ord <= 6),"""
_FOLD = f"""l AS (SELECT request, list(cost ORDER BY place) AS cs, list(source ORDER BY place) AS ss, list(coalesce(score, -1) ORDER BY place) AS sc, list(unit ORDER BY place) AS us, list(relevant ORDER BY place) AS rs, max(coverage) AS top FROM u GROUP BY request),
st AS (SELECT request, kind, i, j, n, needed, row_number() OVER (PARTITION BY request ORDER BY kind, n, i) AS step FROM (
  SELECT request, CASE WHEN promoted THEN 2 ELSE 0 END AS kind, i, j, ord AS n, false AS needed FROM p UNION ALL
  SELECT request, CASE WHEN extra THEN 3 ELSE 1 END, place, NULL, NULL, NOT extra AND relevant AND coverage >= top - 1e-9 FROM u JOIN l USING (request))),
fold AS (SELECT request, 0::BIGINT AS step, 0::BIGINT AS used, []::INT[] AS taken, []::INT[] AS rules, []::INT[] AS flagged, false AS missed FROM l
  UNION ALL SELECT request, step, CASE WHEN fits THEN used2 ELSE used END, CASE WHEN fits THEN taken2 ELSE taken END, CASE WHEN kind <= 1 THEN CASE WHEN fits THEN taken2 ELSE taken END ELSE rules END,
    CASE WHEN fits AND j IS NOT NULL THEN list_append(flagged, n) ELSE flagged END, missed OR (NOT fits AND needed)
  FROM (SELECT *, used1 <= {BUDGET} AND used2 <= {BUDGET} AS fits FROM (SELECT *, {_TWO[0]} AS used2, {_TWO[1]} AS taken2 FROM (
    SELECT f.request, s.step, s.kind, s.i, s.j, coalesce(s.j, s.i) AS j2, s.n, s.needed, f.used, f.taken, f.rules, f.flagged, f.missed, l.cs, l.ss, {_ONE[0]} AS used1, {_ONE[1]} AS taken1
    FROM fold f JOIN st s ON s.request = f.request AND s.step = f.step + 1 JOIN l ON l.request = f.request)))),
e AS (SELECT fold.*, l.* EXCLUDE (request), list_sort(taken) AS t FROM fold JOIN l USING (request) QUALIFY row_number() OVER (PARTITION BY fold.request ORDER BY step DESC) = 1),
d AS (SELECT *, list_concat(list_reverse_sort(list_filter(t, lambda i: NOT list_contains(rules, i))), list_reverse_sort(list_filter(t, lambda i: list_contains(rules, i)))) AS drops FROM e),
g AS (SELECT *, list_filter(list_transform(range(0, len(drops) + 1), lambda n: list_filter(t, lambda i: NOT list_contains(drops[1:n], i))), lambda x: {_sql_cost("x")} <= {BUDGET})[1] AS fitting FROM d),
h AS (SELECT *, list_transform(list_sort(list_transform(fitting, lambda i: {{'s': -sc[i], 'i': i}})), lambda x: x.i) AS ordered FROM g),
o AS (SELECT *, list_reverse(list_filter(ordered, lambda i: NOT list_contains(rules, i))) AS outside FROM h),
z AS (SELECT *, coalesce(list_filter(list_transform(range(0, len(outside) + 1), lambda n: list_filter(ordered, lambda i: NOT list_contains(outside[1:n], i))), lambda x: {_sql_cost("x")} <= {BUDGET})[1], fitting) AS final FROM o),
pl AS (SELECT request, list({{'o': ord, 'i': i, 'j': j}} ORDER BY ord) AS ps FROM p GROUP BY request),
y AS (SELECT z.*, coalesce(ps, []) AS ps, list_filter(coalesce(ps, []), lambda x: list_contains(fitting, x.i) AND list_contains(fitting, x.j) AND list_contains(flagged, x.o)) AS kept FROM z LEFT JOIN pl USING (request)),
r AS (SELECT *, list_filter(ps, lambda x: NOT list_contains(list_transform(kept, lambda y: y.o), x.o)) AS missing FROM y)
"""
_PACKED = f"WITH RECURSIVE {_UNITS} {_FOLD}"


@query(f"{_PACKED} SELECT request, array_to_string(list_transform(final, lambda i: us[i]), ',') AS chosen, {_sql_cost('final')} AS used, array_to_string(list_transform(kept, lambda x: x.o), ',') AS flagged FROM r")
def reserved_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request gets, in the order of the model's scores where that fits."""
    return _example(spark, sf_dir).select("request", F.array_join("chosen", ",").alias("chosen"), "used", F.array_join("flagged", ",").alias("flagged"))


@query(f"""{_PACKED} SELECT request, missed OR len(missing) > 0 OR len(list_filter(t, lambda i: NOT list_contains(fitting, i) AND rs[i])) > 0 AS truncated,
  coalesce(array_to_string(list_sort(list_transform(list_filter(list_distinct(flatten(list_transform(missing, lambda x: [x.i, x.j]))), lambda i: NOT list_contains(final, i)), lambda i: us[i])), ','), '') AS omitted FROM r""")
def omitted_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of flagged pairs that did not fit are named, and the answer counts as truncated."""
    return _example(spark, sf_dir).select("request", "truncated", F.array_join(F.array_sort("omitted"), ",").alias("omitted"))


@query(f"{_PACKED} SELECT request, array_to_string(list_sort(list_transform(list_filter(rules, lambda i: NOT list_contains(final, i)), lambda i: us[i])), ',') AS lost, len(rules) AS rules FROM r")
def reorder_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the rules alone pack and the reordered answer lacks: none, but for what the final order's price pushed out."""
    return _example(spark, sf_dir).select("request", F.array_join("violations", ",").alias("lost"), F.size("rules").cast("bigint").alias("rules"))


#: The example's question, of which texts say something with numbers.
ASSEMBLED = QUESTIONS[0]

_ASSEMBLED = f"""WITH RECURSIVE hits AS (WITH {cte(ASSEMBLED)} SELECT * FROM s), best AS (SELECT location, max(raw) AS best FROM hits GROUP BY location),
scored AS (SELECT s.*, raw / best AS score, d.text, d.lang, d.n_chars FROM hits s JOIN best USING (location) JOIN documents d ON d.doc_id = artifact_id),
c AS (SELECT *, -round(score * coverage, 6) AS a1, -round(coverage, 6) AS a2, location <> 'src0' AS a3 FROM scored),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY a3, a1, a2, location, artifact_id) AS copy FROM c),
u AS (SELECT 0 AS request, artifact_id AS unit, CAST(row_number() OVER (ORDER BY a1, a2, a3, location, artifact_id) AS INT) AS place, false AS extra, CAST(n_chars // 3 + 64 AS BIGINT) AS cost, location AS source, lang AS value, coverage >= 0.4 AS relevant, round(coverage, 6) AS coverage, CAST(NULL AS DOUBLE) AS score FROM k WHERE copy = 1 QUALIFY place <= {CANDIDATES}),
units AS (SELECT request, place, unit, coverage, t.terms, d.* FROM u JOIN (SELECT doc_id, text, {TRAITS} FROM documents) d ON d.doc_id = unit, (WITH {cte(ASSEMBLED)} SELECT list(term) AS terms FROM q) t),
{sql_conflicts("units")},
p AS (SELECT found.request, CAST(n AS INT) AS ord, false AS promoted, a.place AS i, b.place AS j FROM found JOIN u a ON a.unit = left_unit JOIN u b ON b.unit = right_unit WHERE kind = 'conflict'),
{_FOLD}"""


@query(f"{_ASSEMBLED} SELECT array_to_string(list_transform(final, lambda i: us[i]), ',') AS chosen, {_sql_cost('final')} AS used, array_to_string(list_transform(kept, lambda x: x.o), ',') AS flagged, missed OR len(missing) > 0 OR len(list_filter(t, lambda i: NOT list_contains(fitting, i) AND rs[i])) > 0 AS truncated FROM r")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request from its question to its evidence by rules alone: search, order, copies, conflicts of the texts, budget. Nothing judges pairs, so none is promoted."""
    rows = _scored(spark, sf_dir, ASSEMBLED)
    best = rows.groupBy("location").agg(F.max("raw").alias("best"))
    keys = rows.join(best, "location").select("artifact_id", "location", "coverage", (-F.round(F.col("raw") / F.col("best") * F.col("coverage"), 6)).alias("a1"), (-F.round("coverage", 6)).alias("a2"), (F.col("location") != "src0").alias("a3"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    keys = keys.join(docs, "artifact_id")
    order = ["a1", "a2", "a3", "location", "artifact_id"]
    kept = keys.groupBy("text_hash").agg(F.min(F.struct("a3", "a1", "a2", "location", "artifact_id", "coverage", "lang", "n_chars")).alias("m")).select("m.*")
    first = kept.orderBy(*order).limit(CANDIDATES)
    place = F.row_number().over(Window.partitionBy("request").orderBy(*order))  # over CANDIDATES rows
    units = first.withColumn("request", F.lit(0)).select(
        "request", F.col("artifact_id").alias("unit"), place.alias("place"), F.lit(False).alias("extra"), F.expr("n_chars div 3 + 64").cast("bigint").alias("cost"), F.col("location").alias("source"), F.col("lang").alias("value"), (F.col("coverage") >= 0.4).alias("relevant"), F.round("coverage", 6).alias("coverage"), F.lit(None).cast("double").alias("score")
    )
    units = written(units)
    terms = F.broadcast(spark.range(1).select(X.content_terms(F.lit(ASSEMBLED)).alias("terms")))  # one row
    compared = units.select("request", "place", "unit", "coverage").crossJoin(terms).join(traits(table(spark, sf_dir, "documents")), F.col("unit") == F.col("doc_id"))
    places = units.select("unit", "place")
    pairs = find_conflicts(compared, DOMAIN).where("kind = 'conflict'").drop("i", "j")
    pairs = pairs.join(places.select(F.col("unit").alias("left_unit"), F.col("place").alias("i")), "left_unit").join(places.select(F.col("unit").alias("right_unit"), F.col("place").alias("j")), "right_unit")
    pairs = pairs.select("request", F.col("n").cast("int").alias("ord"), "i", "j", F.lit(False).alias("promoted"))
    out = packed(units.drop("value"), pairs, BUDGET, GAP)
    return out.select(F.array_join("chosen", ",").alias("chosen"), "used", F.array_join("flagged", ",").alias("flagged"), "truncated")
