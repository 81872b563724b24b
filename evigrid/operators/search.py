"""Ranked search over documents that a reader may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import hub_rows, table

#: The query of the search examples, and who asks.
QUESTION = "Which retries of the tion service are allowed within the blethe and erthe limits?"
GROUPS = ("en", "fr")
K1, B = 1.2, 0.75


def readable(rows: DataFrame, groups: tuple[str, ...], owner: str | None = None, scoped: bool = False) -> DataFrame:
    """Rows whose acl shares a group with the reader and, in a scoped hub, whose owner is the reader. No group reads nothing."""
    seen = F.arrays_overlap("acl", F.array(*(F.lit(g) for g in groups)).cast("array<string>"))
    return rows.where(seen & (F.col("owner") == F.lit(owner)) if scoped else seen)


def term_frequencies(rows: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, term, tf) of stemmed words."""
    return rows.select(key, F.explode(F.transform(X.words(F.col("text")), X.stem)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, question: str, key: str = "artifact_id", keep: tuple[str, ...] = ("location",)) -> DataFrame:
    """(key, *keep, raw, coverage) of rows with a term of the question.

    The texts are read once: what is written of a row is its length and the stems of the few words that could be terms of the
    question. Statistics of the pool are one row of sums, joined back by broadcast of as many rows as the question has terms.
    """
    wanted = rows.sparkSession.range(1).select(X.content_terms(F.lit(question)).alias("t")).first()["t"]
    forms = sorted({form for term in wanted for form in X.forms(term)})
    tokens = rows.select(key, *keep, X.words(F.col("text")).alias("w"))
    stems = F.filter(F.transform(F.filter("w", lambda w: w.isin(forms)), X.stem), lambda t: t.isin(list(wanted)))
    counted = written(tokens.select(key, *keep, F.size("w").alias("len"), stems.alias("terms")))
    each = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))
    tf = counted.where(F.size("terms") > 0).select(key, *keep, "len", F.inline(each))  # counted inside the row: no shuffle
    pool = counted.agg(F.count("*").alias("n"), F.avg(F.greatest("len", F.lit(1)).cast("double")).alias("average"))
    weighed = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(pool))
    weighed = weighed.select("term", "average", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.log(1 + (F.col("n") + 1) / (F.col("df") + 0.5)).alias("w"))
    total = weighed.agg(F.sum("w").alias("total"))
    length = F.greatest(F.col("len"), F.lit(1)).cast("double")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length / F.col("average")))
    scored = tf.join(F.broadcast(weighed), "term").groupBy(key, *keep).agg(F.sum(gain).alias("raw"), F.sum("w").alias("w"))
    return scored.crossJoin(F.broadcast(total)).select(key, *keep, "raw", (F.col("w") / F.col("total")).alias("coverage"))


def cte(question: str) -> str:
    """CTEs up to s (artifact_id, location, raw, coverage) for one question of the example's reader."""
    return f"""
q AS (SELECT DISTINCT {X.sql_stem("w")} AS term FROM (SELECT unnest({X.sql_words(f"'{question}'")}) AS w) WHERE w NOT IN ({X.SQL_STOPWORDS}) AND NOT regexp_matches(w, '^[0-9]+$')),
rows_ AS (SELECT * FROM documents WHERE lang IN ('en', 'fr')),
tok AS (SELECT doc_id, source, unnest({X.sql_words("text")}) AS w FROM rows_),
st AS (SELECT doc_id, source, {X.sql_stem("w")} AS term FROM tok),
len AS (SELECT d.doc_id, greatest(count(st.term), 1) AS len FROM rows_ d LEFT JOIN st ON st.doc_id = d.doc_id GROUP BY d.doc_id),
pool AS (SELECT count(*) AS n, avg(CAST(len AS DOUBLE)) AS average FROM len),
tf AS (SELECT doc_id, source, term, count(*) AS tf FROM st WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (n + 1) / (df + 0.5)) AS w FROM df, pool),
s AS (SELECT tf.doc_id AS artifact_id, source AS location, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) AS raw, sum(w) / (SELECT sum(w) FROM w) AS coverage
  FROM tf JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, pool GROUP BY ALL)
"""


_CTE = cte(QUESTION)


def _scored(spark: SparkSession, sf_dir: str, question: str = QUESTION) -> DataFrame:
    return bm25(readable(hub_rows(spark, sf_dir), GROUPS), question)


def _rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {_CTE} SELECT artifact_id, location, round(raw, 6) AS raw, round(coverage, 6) AS coverage FROM s")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("artifact_id", "location", *_rounded("raw", "coverage"))


@query(f"WITH {_CTE} SELECT artifact_id, round(raw, 6) AS raw FROM s ORDER BY round(raw, 6) DESC, artifact_id LIMIT 10")
def search_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("artifact_id", *_rounded("raw")).orderBy(F.desc("raw"), "artifact_id").limit(10)


@query(f"WITH {_CTE} SELECT artifact_id, location, round(raw / nullif(max(raw) OVER (PARTITION BY location), 0), 6) AS score, round(coverage, 6) AS coverage FROM s")
def search_bm25_norm_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    best = rows.groupBy("location").agg(F.max("raw").alias("best"))  # a bounded row for each source, not a window over a hot one
    return rows.join(best, "location").select("artifact_id", "location", F.round(F.col("raw") / F.nullif("best", F.lit(0.0)), 6).alias("score"), *_rounded("coverage"))


@query(f"WITH {_CTE}, o AS (SELECT artifact_id, location, coverage, raw / max(raw) OVER (PARTITION BY location) AS score FROM s) SELECT artifact_id, row_number() OVER (ORDER BY -round(score * coverage, 6), -round(coverage, 6), location <> 'src0', location, artifact_id) AS rank FROM o ORDER BY rank LIMIT 60")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 candidates in evidence order; an authoritative source goes first among equals."""
    rows = _scored(spark, sf_dir)
    best = rows.groupBy("location").agg(F.max("raw").alias("best"))
    keys = rows.join(best, "location").select("artifact_id", "location", (-F.round(F.col("raw") / F.col("best") * F.col("coverage"), 6)).alias("a"), (-F.round("coverage", 6)).alias("b"), (F.col("location") != "src0").alias("c"))
    first = keys.orderBy("a", "b", "c", "location", "artifact_id").limit(60)
    return first.select("artifact_id", F.row_number().over(Window.orderBy("a", "b", "c", "location", "artifact_id")).cast("bigint").alias("rank"))


@query(f"WITH {_CTE} SELECT count(*) AS visible_total FROM s")
def search_visible_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.count("*").alias("visible_total"))


@query("SELECT doc_id AS artifact_id, source AS location FROM documents WHERE lang IN ('fr') ORDER BY source, doc_id LIMIT 20")
def search_acl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(hub_rows(spark, sf_dir), ("fr",)).select("artifact_id", "location").orderBy("location", "artifact_id").limit(20)


@query("SELECT count(*) AS n FROM documents WHERE false")
def search_no_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader without groups sees nothing."""
    return readable(hub_rows(spark, sf_dir), ()).agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://blog.")).select("page_id", "url")


@query(f"WITH t AS (SELECT doc_id, unnest({X.sql_words('text')}) AS w FROM documents) SELECT doc_id AS artifact_id, {X.sql_stem('w')} AS term, count(*) AS tf FROM t GROUP BY ALL")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(hub_rows(spark, sf_dir))


@query(f"WITH t AS (SELECT doc_id, unnest({X.sql_words('text')}) AS w FROM documents) SELECT {X.sql_stem('w')} AS term, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_distinct(F.transform(F.array_distinct(X.words(F.col("text"))), X.stem))
    distinct = hub_rows(spark, sf_dir).select(F.explode(own).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df"))  # distinct inside the row: one shuffle of partial counts


@query(f"WITH t AS (SELECT DISTINCT w FROM (SELECT unnest({X.sql_words('text')}) AS w FROM documents)) SELECT w AS token, {X.sql_stem('w')} AS stem FROM t")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = hub_rows(spark, sf_dir).select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("token")).distinct()
    return tokens.select("token", X.stem(F.col("token")).alias("stem"))


_INFLECT = "CASE WHEN ends_with(w,'ies') AND length(w) > 4 THEN left(w, length(w)-3) || 'y' WHEN ends_with(w,'y') AND length(w) > 3 THEN left(w, length(w)-1) || 'ies' WHEN ends_with(w,'s') AND NOT ends_with(w,'ss') AND length(w) > 3 THEN left(w, length(w)-1) WHEN length(w) > 2 THEN w || 's' END"


@query(f"WITH t AS (SELECT DISTINCT w FROM (SELECT unnest({X.sql_words('text')}) AS w FROM benchmark) WHERE NOT regexp_matches(w, '[0-9]')) SELECT w AS token, {_INFLECT} AS form FROM t")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("token")).where(~F.col("token").rlike("[0-9]")).distinct()
    return tokens.select("token", X.inflections(F.col("token")).alias("form"))


@query(f"""WITH t AS (SELECT item_id, list_distinct(list_transform({X.sql_words('text')}, lambda w: {X.sql_stem('w')})) AS ts FROM benchmark), n AS (SELECT count(*) AS n FROM t),
x AS (SELECT item_id, unnest(ts) AS term FROM t), df AS (SELECT term, count(*) AS df FROM x GROUP BY term), w AS (SELECT term, ln(1 + CAST(n + 1 AS DOUBLE) / (1 + df)) AS w FROM df, n),
v AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM x JOIN w USING (term) GROUP BY item_id),
p AS (SELECT a.item_id AS a, b.item_id AS b, sum(w.w * w.w) AS dot FROM x a JOIN x b ON a.term = b.term AND a.item_id < b.item_id JOIN w ON w.term = a.term GROUP BY ALL)
SELECT a, b, round(dot / (va.norm * vb.norm), 6) AS cosine FROM p JOIN v va ON va.item_id = a JOIN v vb ON vb.item_id = b""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of term sets of benchmark items that share a term."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.transform(X.words(F.col("text")), X.stem))).alias("term"))
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    w = rows.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", F.log(1 + (F.col("n") + 1) / (1 + F.col("df"))).alias("w"))
    x = rows.join(w, "term")
    norm = x.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    pairs = x.alias("x").join(x.alias("y"), (F.col("x.term") == F.col("y.term")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("dot"))
    left, right = (norm.select(F.col("item_id").alias(k), F.col("norm").alias(f"norm_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), 6).alias("cosine"))
