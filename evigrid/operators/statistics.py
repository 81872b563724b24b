"""Rates, intervals and comparisons over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import numeric as N
from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.tables import calibration_records, calls, table

_CAL = "cal AS (SELECT d.doc_id AS c, d.source AS grp, round(1.0::DOUBLE / (1.0::DOUBLE + n_chars / 1000.0::DOUBLE), 6) AS p, CAST(quality AS INT) AS y FROM labels l JOIN documents d USING (doc_id))"


@query("SELECT event_type AS source_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda s: F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY latency)")  # noqa: E731  counts by value, not lists
    return calls(spark, sf_dir).groupBy("source_id").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("""WITH op AS (SELECT user_id, event_type, bool_or(event_type <> 'error') AS ok FROM events GROUP BY ALL)
SELECT event_type AS source_id, count(*) AS operations, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (NOT ok) / count(*)::DOUBLE, 6) AS failed_rate FROM op GROUP BY event_type""")
def degradation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation of a request failed if none of its attempts succeeded."""
    op = calls(spark, sf_dir).groupBy("request_id", "source_id").agg(F.bool_or(F.col("outcome") == "ok").alias("ok"))
    failed = F.count_if(~F.col("ok"))
    return op.groupBy("source_id").agg(F.count("*").alias("operations"), failed.alias("failed"), F.round(failed / F.count("*"), 6).alias("failed_rate"))


@query("WITH s AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1) SELECT a.event_type AS source_id, round(a.v - b.v, 6) AS delta FROM s a LEFT JOIN s b ON b.event_type = 'view'")
def deltas_vs_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calls(spark, sf_dir).groupBy("source_id").agg(F.avg("latency").alias("v"))
    base = s.where("source_id = 'view'").select(F.col("v").alias("base"))
    return s.join(F.broadcast(base), F.lit(True), "left").select("source_id", F.round(F.col("v") - F.col("base"), 6).alias("delta"))  # the base is one row


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the mean price under two priorities, only of customers with both."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    arm = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    both = o.groupBy(F.col("o_custkey").alias("case")).agg(arm("1-URGENT").alias("a"), arm("5-LOW").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("cluster")), "case").select("case", "family", "cluster", (F.col("b") - F.col("a")).alias("d"))


_ARMS = "arms AS (SELECT o_custkey AS c, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') - avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS d, c_mktsegment AS family, c_nationkey AS cluster FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING d IS NOT NULL)"


@query(f"WITH {_ARMS} SELECT coalesce(family, 'pooled') AS scope, count(*) AS n, round(avg(d), 2) AS delta, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM arms GROUP BY GROUPING SETS ((), (family))", name="paired_delta_by_family")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled and per family in one pass."""
    rows = _arms(spark, sf_dir).groupingSets([[], ["family"]], "family").agg(F.count("*").alias("n"), F.round(F.avg("d"), 2).alias("delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))
    return rows.select(F.coalesce("family", F.lit("pooled")).alias("scope"), "n", "delta", "wins", "losses")


_DRAW = "CAST(('0x' || left(md5('7|' || b || '|' || slot), 8)) AS BIGINT)"


@query(f"""WITH {_ARMS}, k AS (SELECT cluster, sum(d) AS s, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS i FROM arms GROUP BY cluster), m AS (SELECT count(*) AS m FROM k),
g AS (SELECT b, slot, {_DRAW} % m AS i FROM range(200) x(b), (SELECT i AS slot FROM k), m),
st AS (SELECT b, sum(s) / sum(n) AS v FROM g JOIN k USING (i) GROUP BY b), o AS (SELECT list_sort(list(v)) AS vs FROM st)
SELECT round(vs[CAST(floor(0.025 * 199) AS INT) + 1], 2) AS low, round(vs[CAST(floor(0.975 * 199) AS INT) + 1], 2) AS high FROM o""")
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clusters are drawn again and again; draws are hashes, so any engine repeats them.

    Clusters are summed first: what is resampled has as many rows as there are clusters, not cases.
    """
    sums = _arms(spark, sf_dir).groupBy("cluster").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    numbered = running(sums, [], ["cluster"], F.lit(1), "place").withColumn("i", (F.col("place") - 1).cast("bigint"))
    m = numbered.agg(F.count("*").alias("m"))
    slots = spark.range(200).select(F.col("id").alias("b")).crossJoin(F.broadcast(m)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    drawn = slots.select("b", F.pmod(N.draw(F.lit(7), F.col("b"), F.col("slot")), F.col("m")).alias("i")).join(numbered, "i")
    values = drawn.groupBy("b").agg((F.sum("s") / F.sum("n")).alias("v")).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return values.select(F.round(F.col("vs")[int(0.025 * 199)], 2).alias("low"), F.round(F.col("vs")[int(0.975 * 199)], 2).alias("high"))


@query(f"WITH {_CAL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM cal), t AS (SELECT sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM r) SELECT round((s - pos * (pos + 1) / 2.0::DOUBLE) / nullif(pos * neg, 0), 6) AS auc FROM t")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sum with ties at a half, from counts by score: the window runs over distinct scores."""
    by = calibration_records(spark, sf_dir).groupBy("p_raw").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p_raw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = by.select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won"))
    return pairs.agg(F.round(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))


@query(f"WITH {_CAL}, o AS (SELECT y, sum(y) OVER w / row_number() OVER w::DOUBLE AS prec FROM cal WINDOW w AS (ORDER BY p DESC, c ROWS UNBOUNDED PRECEDING)) SELECT round(avg(prec), 6) AS pr_auc FROM o WHERE y = 1")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision; both counts of a record's place are running sums over ranges, not one window."""
    rows = calibration_records(spark, sf_dir).select((-F.col("p_raw")).alias("least"), "case", "label")
    rows = running(running(rows, [], ["least", "case"], F.col("label"), "hits"), [], ["least", "case"], F.lit(1), "seen")
    rows = rows.select("label", (F.col("hits") / F.col("seen")).alias("p"))
    return rows.where("label = 1").agg(F.round(F.avg("p"), 6).alias("pr_auc"))


@query(f"WITH {_CAL}, b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM cal GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = calibration_records(spark, sf_dir).groupBy(F.least(F.floor(F.col("p_raw") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p_raw").alias("p"), F.avg("label").alias("y"))
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


@query(f"WITH {_CAL}, k AS (SELECT y, greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) AS p, p AS raw FROM cal) SELECT round(avg((raw - y) * (raw - y)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM k")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = N.clamp(F.col("p_raw")), F.col("label")
    return calibration_records(spark, sf_dir).agg(F.round(F.avg((F.col("p_raw") - y) * (F.col("p_raw") - y)), 6).alias("brier"), F.round(-F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))), 6).alias("log_loss"))


@query("WITH s AS (SELECT event_type AS source_id, count(*) FILTER (value > 50)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT source_id, round(greatest(0, (k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS low, round(least(1, (k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 6) AS high FROM s")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = N.wilson(F.col("k"), F.col("n"))
    return calls(spark, sf_dir).groupBy("source_id").agg(F.count_if(F.col("latency") > 50).alias("k"), F.count("*").alias("n")).select("source_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_BANDS = f"WITH {_CAL}, b AS (SELECT i / 20.0::DOUBLE AS band FROM range(21) t(i)), s AS (SELECT band, count(*) FILTER (p < band AND y = 1) AS harm, count(*) FILTER (p >= band AND y = 0) AS wrong, count(*) FILTER (p >= band) AS used, (SELECT count(*) FROM cal WHERE y = 1) AS pos FROM b, cal GROUP BY band)"


@query(f"{_BANDS} SELECT max(band) FILTER (harm <= 0.05 * pos) AS skip_band, coalesce(min(band) FILTER (used > 0 AND wrong <= 0.1 * used), 1.0) AS use_band FROM s")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest threshold below which few useful cases are lost, and the lowest above which few useless ones pass."""
    rows = calibration_records(spark, sf_dir).groupBy("p_raw", "label").agg(F.count("*").alias("n"))
    grid = spark.range(21).select((F.col("id") / 20).alias("band"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    p, y = F.col("p_raw"), F.col("label")
    s = rows.crossJoin(F.broadcast(grid)).groupBy("band").agg(n((p < F.col("band")) & (y == 1)).alias("harm"), n((p >= F.col("band")) & (y == 0)).alias("wrong"), n(p >= F.col("band")).alias("used"), n(y == 1).alias("pos"))
    return s.agg(F.max(F.when(F.col("harm") <= 0.05 * F.col("pos"), F.col("band"))).alias("skip_band"), F.coalesce(F.min(F.when((F.col("used") > 0) & (F.col("wrong") <= 0.1 * F.col("used")), F.col("band"))), F.lit(1.0)).alias("use_band"))


_FOLD = f"{_CAL}, f AS (SELECT grp, (row_number() OVER (ORDER BY md5('11|' || grp), grp) - 1) % 5 AS fold FROM (SELECT DISTINCT grp FROM cal))"


@query(f"WITH {_FOLD} SELECT grp, fold FROM f")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, never cases, are shuffled by a seeded hash and dealt to folds."""
    return folds(calibration_records(spark, sf_dir))


def folds(records: DataFrame, k: int = 5, seed: int = 11) -> DataFrame:
    groups = records.select("grp").distinct()
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "grp").cast("binary")), "grp")
    return groups.select("grp", F.pmod(F.row_number().over(order) - 1, F.lit(k)).cast("bigint").alias("fold"))


@query(f"WITH {_FOLD}, s AS (SELECT fold, sum(y) AS y, count(*) AS n FROM cal JOIN f USING (grp) GROUP BY fold), t AS (SELECT sum(y) AS y, sum(n) AS n FROM s) SELECT fold, round((t.y - s.y)::DOUBLE / nullif(t.n - s.n, 0), 6) AS base_rate FROM s, t")
def oof_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = calibration_records(spark, sf_dir)
    s = records.join(folds(records), "grp").groupBy("fold").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    t = s.agg(F.sum("y").alias("ty"), F.sum("n").alias("tn"))
    return s.crossJoin(F.broadcast(t)).select("fold", F.round((F.col("ty") - F.col("y")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), 6).alias("base_rate"))


@query(f"WITH {_CAL} SELECT grp, round(avg(ln(greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE)))), 6) AS mean_logit, round(coalesce(stddev_samp(p), 0), 6) AS sd, count(*) AS n FROM cal GROUP BY grp")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_records(spark, sf_dir).groupBy("grp").agg(F.round(F.avg(N.logit(F.col("p_raw"))), 6).alias("mean_logit"), F.round(F.coalesce(F.stddev_samp("p_raw"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("n"))


@query("SELECT event_type AS source_id, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_total FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k_total"))
