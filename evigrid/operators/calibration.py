"""Calibrators of raw probabilities, fitted by passes over counts, and their nested validation over groups.

Records (grp, p_raw, label) are counted by probability first. A Newton step is one aggregate over those counts for all fits at once;
only gradients and Hessians, one row a fit, come to the driver. Null probabilities or labels take no part; without records there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import numeric as N
from evigrid.operators.statistics import _CAL, folds
from evigrid.plans.registry import query
from evigrid.sources.tables import calibration_records

#: Calibrators and their penalties on slope and intercept; without a slope's penalty the slope stays 1.
CALIBRATORS = {"platt": (0.0, 0.0), "platt_l2": (1.0, 0.01), "intercept_only": (None, 1e-4)}
ITERATIONS, TOLERANCE = 50, 1e-9


def counted(records: DataFrame, *keys: str) -> DataFrame:
    """(*keys, p_raw, x, y, n): equal records once."""
    rows = records.where("p_raw IS NOT NULL AND label IS NOT NULL").groupBy(*keys, "p_raw", F.col("label").cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
    return rows.withColumn("x", N.logit(F.col("p_raw")))


def newton(rows: DataFrame, calibrators: dict[str, str]) -> dict[str, tuple[float, float]]:
    """Slope and intercept of each fit over rows (fit, x, y, n); calibrators names the calibrator of each fit.

    A fit whose labels are of one class answers with their base rate. Fits without rows are left out.
    """
    spark = rows.sparkSession
    totals = {r["fit"]: r["rate"] for r in rows.groupBy("fit").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("rate")).collect()}
    done = {f: (0.0, 40.0 if rate > 0 else -40.0) for f, rate in totals.items() if rate in (0.0, 1.0)}
    weights = {f: (1.0 if CALIBRATORS[calibrators[f]][0] is None else 0.0, 0.0) for f in totals if f not in done}
    for _ in range(ITERATIONS):
        if not weights:
            break
        state = spark.createDataFrame([(f, *w) for f, w in weights.items()], "fit string, a double, b double")
        p = N.sigmoid(F.col("a") * F.col("x") + F.col("b"))
        gap, bend = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        x = F.col("x")
        sums = rows.join(F.broadcast(state), "fit").groupBy("fit").agg(F.sum(gap * x).alias("ga"), F.sum(gap).alias("gb"), F.sum(bend * x * x).alias("aa"), F.sum(bend * x).alias("ab"), F.sum(bend).alias("bb"))
        for r in sums.collect():
            a, b = weights[r["fit"]]
            l2a, l2b = CALIBRATORS[calibrators[r["fit"]]]
            gb, bb = r["gb"] + l2b * b, r["bb"] + l2b
            if l2a is None:
                step = (0.0, gb / max(bb, 1e-12))
            else:
                ga, aa = r["ga"] + l2a * a, r["aa"] + l2a
                det = aa * bb - r["ab"] ** 2
                det = det if abs(det) > 1e-12 else 1e-12
                step = ((ga * bb - gb * r["ab"]) / det, (gb * aa - ga * r["ab"]) / det)
            new = (a - step[0], b - step[1])
            if max(map(abs, step)) < TOLERANCE or not all(map(math.isfinite, new)):
                done[r["fit"]] = new if all(map(math.isfinite, new)) else (a, b)
                del weights[r["fit"]]
            else:
                weights[r["fit"]] = new
    return done | weights


def _fitted(spark: SparkSession, sf_dir: str, calibrator: str) -> DataFrame:
    rows = counted(calibration_records(spark, sf_dir)).withColumn("fit", F.lit(calibrator)).persist()
    found = newton(rows, {calibrator: calibrator})
    rows.unpersist()
    return spark.createDataFrame([(round(a, 4), round(b, 4)) for a, b in found.values()], "slope double, intercept double")


def _newton_sql(start: str, step: str, columns: str) -> str:
    """The same steps unrolled."""
    logit = "ln(greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(p, 0.999999::DOUBLE), 0.000001::DOUBLE)))"
    parts = [_CAL, f"k AS MATERIALIZED (SELECT y, {logit} AS x FROM cal)", f"w0 AS (SELECT {start})"]
    for i in range(14):
        parts.append(f"s{i} AS MATERIALIZED (SELECT a, b, sum((p - y) * x) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) AS aa, sum(p * (1 - p) * x) AS ab, sum(p * (1 - p)) AS bb FROM (SELECT y, x, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM k, w{i}) GROUP BY a, b)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT {step} FROM s{i})")
    return f"WITH {', '.join(parts)} SELECT {columns} FROM w14"


_ROUNDED = "round(a, 4) AS slope, round(b, 4) AS intercept"


@query(_newton_sql("0.0::DOUBLE AS a, 0.0::DOUBLE AS b", "a - (ga * bb - gb * ab) / (aa * bb - ab * ab) AS a, b - (gb * aa - ga * ab) / (aa * bb - ab * ab) AS b", _ROUNDED))
def platt_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "platt")


@query(_newton_sql("0.0::DOUBLE AS a, 0.0::DOUBLE AS b", "a - ((ga + a) * (bb + 0.01::DOUBLE) - (gb + 0.01::DOUBLE * b) * ab) / ((aa + 1) * (bb + 0.01::DOUBLE) - ab * ab) AS a, b - ((gb + 0.01::DOUBLE * b) * (aa + 1) - (ga + a) * ab) / ((aa + 1) * (bb + 0.01::DOUBLE) - ab * ab) AS b", _ROUNDED))
def platt_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "platt_l2")


@query(_newton_sql("1.0::DOUBLE AS a, 0.0::DOUBLE AS b", "a, b - (gb + 0.0001::DOUBLE * b) / (bb + 0.0001::DOUBLE) AS b", _ROUNDED))
def intercept_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "intercept_only")


def source_intercepts(records: DataFrame, l2: float = 1.0) -> tuple[float, float, dict[str, float]]:
    """Slope, intercept and each source's own intercept. Sources are few; each gives one row of sums a step.

    The Hessian is dense in slope and intercept and diagonal in the sources, which are eliminated before the two are solved.
    """
    rows = counted(records, "grp").persist()
    a = b = 0.0
    own: dict[str, float] = {r["grp"]: 0.0 for r in rows.select("grp").distinct().collect()}
    for _ in range(ITERATIONS if own else 0):
        state = records.sparkSession.createDataFrame(list(own.items()), "grp string, o double")
        x, p = F.col("x"), N.sigmoid(F.lit(a) * F.col("x") + F.lit(b) + F.col("o"))
        gap, bend = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        joined = rows.join(F.broadcast(state), rows["grp"].eqNullSafe(state["grp"])).select(state["grp"].alias("s"), "o", gap.alias("gap"), bend.alias("bend"), x)
        got = joined.groupBy("s", "o").agg(F.sum(F.col("gap") * x).alias("ga"), F.sum("gap").alias("g"), F.sum(F.col("bend") * x * x).alias("aa"), F.sum(F.col("bend") * x).alias("ab"), F.sum("bend").alias("h")).collect()
        v = np.array([[r["ab"], r["h"]] for r in got])
        d = v[:, 1] + l2
        g = np.array([r["g"] + l2 * r["o"] for r in got])
        top = np.array([sum(r["ga"] for r in got) + 1e-4 * a, sum(r["g"] for r in got) + 1e-4 * b])
        h = np.array([[sum(r["aa"] for r in got) + 1e-4, v[:, 0].sum()], [v[:, 0].sum(), v[:, 1].sum() + 1e-4]])
        step = np.linalg.solve(h - (v / d[:, None]).T @ v, top - v.T @ (g / d))
        each = (g - v @ step) / d
        a, b = a - float(step[0]), b - float(step[1])
        own = {r["s"]: r["o"] - float(s) for r, s in zip(got, each, strict=True)}
        if max(np.abs(step).max(), np.abs(each).max()) < TOLERANCE:
            break
    rows.unpersist()
    return a, b, own


@query(name="source_intercepts")
def source_intercepts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, own = source_intercepts(calibration_records(spark, sf_dir))
    return spark.createDataFrame([(s, round(a, 4), round(b + o, 4)) for s, o in own.items()], "grp string, slope double, intercept double")


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (low, high, total, n) in order: neighbours that do not rise are pooled."""
    out: list[list[float]] = []
    for frame in frames:
        for block in frame.sort_values("low")[["low", "high", "total", "n"]].to_numpy().tolist():
            out.append(block)
            while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
                _, high, total, n = out.pop()
                out[-1] = [out[-1][0], high, out[-1][2] + total, out[-1][3] + n]
    yield pd.DataFrame(out, columns=["low", "high", "total", "n"], dtype="float64")


def isotonic(records: DataFrame) -> DataFrame:
    """(low, high, n, fitted): the steps of the rising function nearest to the labels.

    Ranges of probabilities are pooled in parallel, then their blocks in one task: pooling is free in its order, and what is left are
    at most as many blocks as there are distinct probabilities (a million where they have six places).
    """
    steps = counted(records).groupBy(F.col("p_raw").alias("low")).agg(F.sum(F.col("n") * F.col("y")).alias("total"), F.sum("n").alias("n"))
    steps = steps.select("low", F.col("low").alias("high"), "total", "n")
    shape = "low double, high double, total double, n double"
    parts = steps.repartitionByRange("low").sortWithinPartitions("low").mapInPandas(_pooled, shape)
    whole = parts.repartition(1).sortWithinPartitions("low").mapInPandas(_pooled, shape)
    return whole.select("low", "high", F.col("n").cast("bigint").alias("n"), (F.col("total") / F.col("n")).alias("fitted"))


@query(f"""WITH {_CAL}, s AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(sum(y)) OVER w AS y, sum(count(*)) OVER w AS n, sum(y) AS y1, count(*) AS n1 FROM cal GROUP BY p WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.i AS a, b.i AS b, (b.y - a.y + a.y1)::DOUBLE / (b.n - a.n + a.n1)::DOUBLE AS v FROM s a JOIN s b ON a.i <= b.i), l AS (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS v FROM m),
g AS (SELECT b AS i, max(v) AS g FROM l GROUP BY b) SELECT min(p) AS low, max(p) AS high, sum(n1)::BIGINT AS n, round(g, 6) AS fitted FROM s JOIN g USING (i) GROUP BY g""")
def isotonic_pav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isotonic(calibration_records(spark, sf_dir)).withColumn("fitted", F.round("fitted", 6))


def nested_cv(records: DataFrame, outer: int = 5, inner: int = 4, seed: int = 11) -> DataFrame:
    """(fold, n, positives, groups, calibrator, log_loss, brier, auc) of each held-out fold of groups.

    Inside each training part the calibrator with the least out-of-fold log loss is chosen, then fitted on the whole part. Folds
    whose training labels are of one class are left out. All fits of all folds advance in the same passes.
    """
    spark = records.sparkSession
    parts = folds(records, outer, seed).select("grp", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("o"))
    held = F.col("own") == F.col("o")
    order = Window.partitionBy("o", held).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "grp").cast("binary")), "grp")
    parts = parts.withColumn("i", F.when(~held, F.pmod(F.row_number().over(order) - 1, F.lit(inner)))).select("grp", "o", "i")
    rows = counted(records.join(parts, "grp"), "o", "i").persist()
    names = list(CALIBRATORS)

    def fit(part):
        return F.concat_ws("|", "calibrator", F.col("o").cast("string"), part.cast("string"))

    training = rows.where("i IS NOT NULL").withColumn("calibrator", F.explode(F.array(*(F.lit(n) for n in names))))
    training = training.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(inner - 1)))).where("part <> i").withColumn("fit", fit(F.col("part")))
    models = newton(training, {f"{n}|{o}|{i}": n for n in names for o in range(outer) for i in range(-1, inner)})
    model = spark.createDataFrame([(f, *w) for f, w in models.items()], "fit string, a double, b double")
    p = N.sigmoid(F.col("a") * F.col("x") + F.col("b"))
    loss = -F.col("n") * (F.col("y") * F.log(F.greatest(F.col("p"), F.lit(N.EPSILON))) + (1 - F.col("y")) * F.log(F.greatest(1 - F.col("p"), F.lit(N.EPSILON))))
    tried = training.where("part = -1").withColumn("fit", fit(F.col("i"))).join(F.broadcast(model), "fit").withColumn("p", p)
    losses = {(r["o"], r["calibrator"]): r["v"] for r in tried.groupBy("o", "calibrator").agg((F.sum(loss) / F.sum("n")).alias("v")).collect()}
    classes = {r["o"] for r in rows.where("i IS NOT NULL").groupBy("o").agg(F.countDistinct("y").alias("c")).where("c > 1").collect()}
    chosen = [(o, best, *models[f"{best}|{o}|-1"]) for o in sorted(classes) if (best := min((n for n in names if (o, n) in losses), key=lambda n: losses[o, n], default=None))]
    tests = rows.where("i IS NULL").join(F.broadcast(spark.createDataFrame(chosen, "o int, calibrator string, a double, b double")), "o").withColumn("p", p)
    by = tests.groupBy("o", "p").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = by.select("o", "pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won")).groupBy("o").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    n = F.col("n")
    scores = tests.groupBy("o", "calibrator").agg(F.sum(n).cast("bigint").alias("n_held"), F.sum(n * F.col("y")).cast("bigint").alias("positives"), (F.sum(loss) / F.sum(n)).alias("log_loss"), (F.sum(n * (F.col("p") - F.col("y")) ** 2) / F.sum(n)).alias("brier"))
    groups = parts.where("i IS NULL").groupBy("o").agg(F.count("*").alias("groups"))
    out = scores.join(auc, "o").join(groups, "o")
    return out.select(F.col("o").cast("bigint").alias("fold"), F.col("n_held").alias("n"), "positives", "groups", "calibrator", *(F.round(c, 6).alias(c) for c in ("log_loss", "brier", "auc")))


@query(name="nested_cv")
def nested_cv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_cv(calibration_records(spark, sf_dir))
