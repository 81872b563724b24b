"""What a question asks for, which labels it names, and the decisions of scored providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.operators.ordering import last_before
from evigrid.operators.search import _CTE, GROUPS, QUESTION, readable
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import calibration_records, calls, hub_rows, table, versioned_rows

# Words that ask for each kind of fact, and the kinds assumed without any.
CUES = {
    "implementation": """config configur configuration code value set implement implementation batch size timeout limit pool retry max
default class constant setting parameter production prod release deploy worker count interval threshold use""".split(),
    "procedure": """how step procedure runbook checklist should must supposed process policy rule guideline cutover rollback drain failover
allow allowed intend wait restart retry limit backoff""".split(),
    "reference": "doc documentation page wiki sla overview describe explain policy backoff schedule document".split(),
    "session_history": "session earlier previous previously note we i my yesterday remember discuss follow".split(),
}
DEFAULT_KINDS = "implementation,procedure,reference"


def fact_kinds(text: Column) -> Column:
    """The kinds of fact whose cues, plain or stemmed, are among a question's words and stems; comma-joined."""
    own = X.words(text)
    raw = F.array_union(own, F.transform(own, X.stem))
    found = [F.when(F.arrays_overlap(raw, F.array_union(cues := F.array(*(F.lit(c) for c in words)), F.transform(cues, X.stem))), kind) for kind, words in CUES.items()]
    return F.coalesce(F.nullif(F.concat_ws(",", *found), F.lit("")), F.lit(DEFAULT_KINDS))


_CUE_ROWS = ", ".join(f"('{kind}', '{cue}')" for kind, words in CUES.items() for cue in words)


@query(f"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, turn, unnest({X.sql_words("text")}) AS w FROM q),
s AS (SELECT conv_id, turn, w FROM t UNION SELECT conv_id, turn, {X.sql_stem("w")} FROM t), c(kind, cue) AS (VALUES {_CUE_ROWS}), cc AS (SELECT kind, cue FROM c UNION SELECT kind, {X.sql_stem("cue")} FROM c),
k AS (SELECT conv_id, turn, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM s JOIN cc ON cue = w GROUP BY ALL) SELECT q.conv_id, q.turn, coalesce(kinds, '{DEFAULT_KINDS}') AS kinds FROM q LEFT JOIN k ON k.conv_id = q.conv_id AND k.turn = q.turn""")
def intent_fact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", fact_kinds(F.col("text")).alias("kinds"))


@query(f"WITH {_CTE} SELECT (SELECT count(*) FROM q) AS terms, (SELECT count(*) FROM q WHERE term NOT IN (SELECT term FROM df)) AS uncovered, round((SELECT count(*) FROM q WHERE term NOT IN (SELECT term FROM df)) / (SELECT count(*) FROM q)::DOUBLE, 6) AS share")
def uncovered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a question's terms that no readable text holds."""
    terms = spark.range(1).select(F.explode(X.content_terms(F.lit(QUESTION))).alias("term"))
    wanted = X.content_terms(F.lit(QUESTION))
    held = readable(hub_rows(spark, sf_dir), GROUPS).select(F.explode(F.array_intersect(wanted, F.transform(X.words(F.col("text")), X.stem))).alias("term")).distinct()
    marked = terms.join(held.withColumn("held", F.lit(True)), "term", "left")
    n, gone = F.count("*"), F.count_if(F.col("held").isNull())
    return marked.agg(n.alias("terms"), gone.alias("uncovered"), F.round(gone / F.nullif(n, F.lit(0)), 6).alias("share"))


#: Words in a label, at most.
LABEL_WORDS = 4


def label_spans(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, start, end, label): longest matches of labels in the words of rows (key, w), left to right, without overlaps."""
    size = F.size("w")
    grams = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LABEL_WORDS), size - i)), lambda k: F.struct(i.alias("start"), (-k).alias("less"), F.array_join(F.slice("w", i + 1, k), " ").alias("label")))))
    known = written(labels.select("label").distinct())  # its size is known, and a semi-join never sends the grams to all
    found = rows.where(size > 0).select("key", F.explode(grams).alias("g")).select("key", "g.*").join(known, "label", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("start", "less", "label")))
    kept = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,less:int,label:string>>").alias("out")),
        lambda acc, x: F.when(x["start"] >= acc["free"], F.struct((x["start"] - x["less"]).alias("free"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc),
    )
    spans = found.groupBy("key").agg(kept["out"].alias("out")).select("key", F.explode("out").alias("x"))
    return spans.select("key", F.col("x.start").cast("bigint").alias("start"), (F.col("x.start") - F.col("x.less")).cast("bigint").alias("end"), "x.label")


@query(rf"""WITH RECURSIVE w AS (SELECT p_partkey AS key, regexp_extract_all(lower(concat_ws(' ', p_name, p_type, p_brand)), '[a-z0-9]+') AS w FROM part),
l AS (SELECT DISTINCT label FROM (SELECT array_to_string(regexp_extract_all(lower(p_type), '[a-z0-9]+'), ' ') AS label FROM part UNION ALL SELECT regexp_extract_all(lower(p_type), '[a-z0-9]+')[1] FROM part UNION ALL SELECT array_to_string(regexp_extract_all(lower(p_brand), '[a-z0-9]+'), ' ') FROM part)),
g AS (SELECT key, s, k, array_to_string(w[s + 1:s + k], ' ') AS label FROM w, range(64) a(s), range(1, 5) b(k) WHERE s + k <= len(w)),
m AS (SELECT key, s, max(s + k) AS e, max_by(g.label, k) AS label FROM g JOIN l USING (label) GROUP BY key, s),
x AS (SELECT a.key, a.s, any_value(a.e) AS e, any_value(a.label) AS label, min(b.s) AS ns FROM m a LEFT JOIN m b ON b.key = a.key AND b.s >= a.e GROUP BY a.key, a.s),
r AS (SELECT x.* FROM x JOIN (SELECT key, min(s) AS s FROM m GROUP BY key) f ON f.key = x.key AND f.s = x.s UNION ALL SELECT x.* FROM r JOIN x ON x.key = r.key AND x.s = r.ns)
SELECT key AS p_partkey, s AS start, e AS "end", label FROM r""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types (whole, or their first word) and brands named in a part's description."""
    p = table(spark, sf_dir, "part")
    words = lambda *c: F.regexp_extract_all(F.lower(F.concat_ws(" ", *c)), F.lit("[a-z0-9]+"), F.lit(0))
    kinds = F.array(F.array_join(words("p_type"), " "), F.try_element_at(words("p_type"), F.lit(1)), F.array_join(words("p_brand"), " "))
    spans = label_spans(p.select(F.col("p_partkey").alias("key"), words("p_name", "p_type", "p_brand").alias("w")), p.select(F.explode(kinds).alias("label")))
    return spans.withColumnRenamed("key", "p_partkey")


@query("""WITH s AS (SELECT p_type AS place, count(DISTINCT p_size % 2) AS n, min(p_size % 2) AS target FROM part WHERE p_retailprice > 1000 GROUP BY 1), e AS (SELECT DISTINCT p_brand AS entity, p_type AS place FROM part),
j AS (SELECT entity, place, CASE WHEN n IS NULL THEN 'unknown_place' WHEN n > 1 THEN 'ambiguous_place' END AS reason, target FROM e LEFT JOIN s USING (place))
SELECT entity, coalesce(min_by(reason, place) FILTER (reason IS NOT NULL), CASE WHEN count(DISTINCT target) > 1 THEN 'conflicting_places' END) AS reason, CASE WHEN count(reason) = 0 AND count(DISTINCT target) = 1 THEN min(target) END AS target FROM j GROUP BY entity""")
def entity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity is what all its places select, if each selects exactly one thing; else the first failing place's reason."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 2
    s = p.where("p_retailprice > 1000").groupBy(F.col("p_type").alias("place")).agg(F.count_distinct(kind).alias("n"), F.min(kind).alias("target"))
    j = p.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("place")).distinct().join(s, "place", "left")
    j = j.withColumn("reason", F.when(F.col("n").isNull(), "unknown_place").when(F.col("n") > 1, "ambiguous_place"))
    g = j.groupBy("entity").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("place"))).alias("first"), F.count("reason").alias("bad"), F.count_distinct("target").alias("targets"), F.min("target").alias("t"))
    reason = F.when(F.col("bad") > 0, F.col("first")).when(F.col("targets") > 1, "conflicting_places")
    return g.select("entity", reason.alias("reason"), F.when((F.col("bad") == 0) & (F.col("targets") == 1), F.col("t")).alias("target"))


@query("""WITH v AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(turn) OVER w AS bt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id AS artifact_id, turn AS revision, CASE WHEN role <> before THEN 'environment_difference' WHEN turn <> bt THEN 'version_difference' ELSE 'contradiction' END AS relation FROM v WHERE before IS NOT NULL""")
def relation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each version stands to the one before it: another environment first, another version next, else a contradiction."""
    v = last_before(versioned_rows(spark, sf_dir), ["artifact_id"], ["revision", "role", "text"], F.struct("role", "revision"), "earlier").where("earlier.role IS NOT NULL")
    kind = F.when(F.col("role") != F.col("earlier.role"), "environment_difference").when(F.col("revision") != F.col("earlier.revision"), "version_difference").otherwise("contradiction")
    return v.select("artifact_id", "revision", kind.alias("relation"))


@query("""WITH r AS (SELECT user_id, list(DISTINCT event_type) AS got, max(value) > 90 AS denied, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1), o(source_id, expected) AS (VALUES ('purchase', 'attempted'), ('signup', 'denied_gap'), ('click', 'unavailable_gap'))
SELECT user_id AS request_id, source_id, CASE expected WHEN 'attempted' THEN list_contains(got, source_id) WHEN 'denied_gap' THEN NOT list_contains(got, source_id) AND denied ELSE list_contains(got, source_id) AND failed END AS ok FROM r, o""")
def mandatory_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each obliged source: asked, refused with a visible gap and no call, or asked without success and a visible gap."""
    duties = F.explode(F.array(*(F.struct(F.lit(s).alias("source_id"), F.lit(e).alias("expected")) for s, e in (("purchase", "attempted"), ("signup", "denied_gap"), ("click", "unavailable_gap")))))
    r = calls(spark, sf_dir).groupBy("request_id").agg(F.collect_set("source_id").alias("got"), (F.max("latency") > 90).alias("denied"), F.bool_or(F.col("outcome") == "error").alias("failed"))
    r = r.withColumn("d", duties).select("*", "d.*")
    asked = F.array_contains("got", F.col("source_id"))
    ok = F.when(F.col("expected") == "attempted", asked).when(F.col("expected") == "denied_gap", ~asked & F.col("denied")).otherwise(asked & F.col("failed"))
    return r.select("request_id", "source_id", ok.alias("ok"))


@query("SELECT conv_id AS item, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, CASE WHEN count(*) FILTER (role = 'assistant') >= count(*) FILTER (role = 'user') THEN 'answered' ELSE 'unavailable' END AS status FROM conversations GROUP BY 1")
def item_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item of several questions is decided only if every one was answered."""
    asked, answered = F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item")).agg(asked.alias("asked"), answered.alias("answered"), F.when(answered >= asked, "answered").otherwise("unavailable").alias("status"))


#: A stand-in provider's slope and intercept, and the bands of its decisions.
SLOPE, INTERCEPT, USE, SKIP = 8.0, -4.0, 0.6, 0.3


@query(f"WITH s AS (SELECT d.doc_id AS \"case\", round(1.0::DOUBLE / (1.0::DOUBLE + n_chars / 1000.0::DOUBLE), 6) AS x FROM labels l JOIN documents d USING (doc_id)), p AS (SELECT \"case\", round(1 / (1 + exp(-({SLOPE}::DOUBLE * x + {INTERCEPT}::DOUBLE))), 4) AS p FROM s) SELECT \"case\", p, CASE WHEN p >= {USE} THEN 'use' WHEN p < {SKIP} THEN 'skip' ELSE 'preserve' END AS decision FROM p")
def standin_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(SLOPE) * F.col("p_raw") + F.lit(INTERCEPT)))), 4)
    rows = calibration_records(spark, sf_dir).select("case", p.alias("p"))
    return rows.select("case", "p", F.when(F.col("p") >= USE, "use").when(F.col("p") < SKIP, "skip").otherwise("preserve").alias("decision"))


_FTS_WORDS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def fts_words(text: Column) -> Column:
    """Words of any script, without accents."""
    return F.regexp_extract_all(X.without_marks(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@query(rf"""WITH q AS (SELECT DISTINCT unnest({_FTS_WORDS.format("'" + QUESTION + "'")}) AS w), d AS (SELECT doc_id, lang, {_FTS_WORDS.format("coalesce(text, '')")} AS w FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)::DOUBLE) AS average FROM d),
t AS (SELECT doc_id, lang, len(w) AS len, unnest(w) AS w FROM d), f AS (SELECT doc_id, lang, len, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL), k AS (SELECT w, count(*) AS df FROM f GROUP BY w),
i AS (SELECT w, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM k, s)
SELECT doc_id AS artifact_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) AS rank FROM f JOIN i USING (w), s WHERE lang IN ('en', 'fr') GROUP BY doc_id""")
def search_fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of a full-text index (least is best): statistics over all rows, also those that the reader may not see; rows after that."""
    wanted = F.array_distinct(fts_words(F.lit(QUESTION)))
    rows = hub_rows(spark, sf_dir).select("artifact_id", "acl", fts_words(F.col("text")).alias("w"))
    pool = rows.agg(F.count("*").cast("double").alias("total"), F.avg(F.size("w").cast("double")).alias("average"))
    hits = rows.select("artifact_id", "acl", F.size("w").alias("len"), F.explode(F.filter("w", lambda w: F.array_contains(wanted, w))).alias("word"))
    tf = hits.groupBy("artifact_id", "acl", "len", "word").agg(F.count("*").alias("tf"))
    raw = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = tf.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(pool)).select("word", "average", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf"))
    gain = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("average")))
    seen = readable(tf, GROUPS).join(F.broadcast(idf), "word")  # as many rows as the question has words
    return seen.groupBy("artifact_id").agg(F.round(-F.sum(gain), 6).alias("rank"))


#: Words of a snippet.
SNIPPET = 16


@query(rf"""WITH q AS (SELECT DISTINCT unnest({_FTS_WORDS.format("'" + QUESTION + "'")}) AS w), d AS (SELECT doc_id, {_FTS_WORDS.format("coalesce(text, '')")} AS w FROM documents WHERE lang IN ('en', 'fr')),
h AS (SELECT doc_id, pos FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM d) WHERE x IN (SELECT w FROM q)),
n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND {SNIPPET - 1} FOLLOWING) AS n FROM h), b AS (SELECT doc_id, min(pos) AS pos FROM n SEMI JOIN (SELECT doc_id, max(n) AS n FROM n GROUP BY 1) m USING (doc_id, n) GROUP BY 1)
SELECT doc_id AS artifact_id, CASE WHEN pos > 0 THEN '… ' ELSE '' END || array_to_string(w[pos + 1:pos + {SNIPPET}], ' ') || CASE WHEN pos + {SNIPPET} < len(w) THEN ' …' ELSE '' END AS snippet FROM b JOIN d USING (doc_id)""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each readable text with a hit, the words from the hit on whose window holds the most hits, the first of them."""
    wanted = F.array_distinct(fts_words(F.lit(QUESTION)))
    rows = readable(hub_rows(spark, sf_dir), GROUPS).select("artifact_id", fts_words(F.col("text")).alias("w"))
    hits = rows.select("artifact_id", F.posexplode(F.transform("w", lambda w: F.array_contains(wanted, w))).alias("pos", "hit")).where("hit")
    reach = Window.partitionBy("artifact_id").orderBy("pos").rangeBetween(0, SNIPPET - 1)
    best = hits.withColumn("n", F.count("*").over(reach)).groupBy("artifact_id").agg(F.min(F.struct(-F.col("n"), "pos"))["pos"].alias("pos"))
    middle = F.array_join(F.slice("w", F.col("pos") + 1, F.lit(SNIPPET)), " ")
    text = F.concat(F.when(F.col("pos") > 0, "… ").otherwise(""), middle, F.when(F.col("pos") + SNIPPET < F.size("w"), " …").otherwise(""))
    return rows.join(best, "artifact_id").select("artifact_id", text.alias("snippet"))
