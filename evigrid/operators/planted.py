"""Derivation and checks of a build: who may see what, whether planted situations show, whose names are whose, what an index holds after changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import last_before
from evigrid.plans.registry import query
from evigrid.sources.tables import table, versioned_rows


def access(rows: DataFrame, groups: tuple[str, ...], principal: str, held_back: tuple[str, ...] = (), restricted: tuple[tuple[str, str], ...] = (), personal: tuple[str, ...] = ()) -> DataFrame:
    """rows (hub, place, acl, owner, ..) with held_back, restricted, can_read and hidden.

    A held-back hub is read by nobody; in a personal hub only the owner reads; otherwise a group must be in the acl. A row of a hub
    that is not held back, but that may not be read, is hidden. A null acl is read by nobody.
    """
    back = F.coalesce(F.col("hub").isin(*held_back), F.lit(False))
    locked = F.coalesce(F.concat_ws("\u001f", "hub", "place").isin(*("\u001f".join(r) for r in restricted)), F.lit(False))
    own = ~F.coalesce(F.col("hub").isin(*personal), F.lit(False)) | F.coalesce(F.col("owner") == principal, F.lit(False))
    reads = ~back & own & F.coalesce(F.arrays_overlap("acl", F.array(*map(F.lit, groups)).cast("array<string>")), F.lit(False))
    return rows.withColumns({"held_back": back, "restricted": locked, "can_read": reads, "hidden": ~back & ~reads})


#: Stand-ins: hubs that are not released, restricted places, hubs of personal memories.
HELD_BACK, RESTRICTED, PERSONAL = ("src7", "src17"), tuple((f"src{i}", "de") for i in (3, 13)), ("src5",)

_ACCESS = """a AS (SELECT doc_id, n_chars % 50 AS entity, source IN ('src7', 'src17') AS held_back, source IN ('src3', 'src13') AND lang = 'de' AS restricted,
source NOT IN ('src7', 'src17') AND (source <> 'src5' OR doc_id % 4 = 1) AND lang IN ('en', 'fr') AS can_read FROM documents)"""


def _accessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50).alias("entity"), F.col("source").alias("hub"), F.col("lang").alias("place"), F.array("lang").alias("acl"), owner.alias("owner"))
    return access(rows, ("en", "fr"), "p1", HELD_BACK, RESTRICTED, PERSONAL)


@query(f"WITH {_ACCESS} SELECT doc_id, held_back, restricted, can_read, NOT held_back AND NOT can_read AS hidden FROM a")
def case_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accessed(spark, sf_dir).select("doc_id", "held_back", "restricted", "can_read", "hidden")


@query(f"WITH {_ACCESS} SELECT entity, bool_or(NOT restricted AND can_read) AS visible, bool_or(NOT restricted AND NOT held_back) AS has_artifacts FROM a GROUP BY entity")
def entity_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity is visible through any unrestricted artifact about it that may be read; it has artifacts when some are released."""
    rows = _accessed(spark, sf_dir).groupBy("entity")
    return rows.agg(F.bool_or(~F.col("restricted") & F.col("can_read")).alias("visible"), F.bool_or(~F.col("restricted") & ~F.col("held_back")).alias("has_artifacts"))


def span_problems(planted: DataFrame, spans: DataFrame) -> DataFrame:
    """(planted, kind, problem) of planted situations (planted, kind) whose artifacts' spans (planted, hub, release, version, role, value) don't show them.

    conflict: two values at the release 'F'. multi_hub_fact: two hubs. rule_missed: what is implemented differs from the procedure, and the
    procedure is the policy. version_branching: versions 1 to 3. newer_not_applicable: versions 1 and 2 both assert, and not the same
    values. capability_gap: one version. coverage_gap needs nothing; any other kind needs a span. Values are counted before they meet
    their situation, so that no array grows with the spans.
    """
    role = lambda r: F.min(F.when(F.col("role") == r, F.col("value")))
    at = lambda v: F.max(F.when(F.col("version") == v, 1).otherwise(0))
    value = spans.groupBy("planted", "value").agg(
        F.max(F.when(F.col("release") == "F", 1).otherwise(0)).alias("now"), at(1).alias("older"), at(2).alias("newer"), at(3).alias("third"), F.min("hub").alias("hub"), F.max("hub").alias("hub2"),
        F.min("version").alias("version"), F.max("version").alias("version2"), *(role(r).alias(r) for r in ("implemented", "procedure", "policy")),
    )
    seen = value.groupBy("planted").agg(
        F.sum("now").alias("now"), F.max("older").alias("older"), F.max("newer").alias("newer"), F.max("third").alias("third"), F.max((F.col("older") != F.col("newer")).cast("int")).alias("differ"),
        (F.min("hub") != F.max("hub2")).alias("hubs"), (F.min("version") != F.max("version2")).alias("versions"), *(F.min(r).alias(r) for r in ("implemented", "procedure", "policy")),
    )
    kind = lambda k: F.col("kind") == k
    none = F.col("now").isNull()
    rules = (
        (none & ~kind("coverage_gap"), "no artifact shows it"),
        (kind("conflict") & (F.col("now") < 2), "sources do not disagree"),
        (kind("multi_hub_fact") & ~F.col("hubs"), "not in two hubs"),
        (kind("rule_missed") & F.col("implemented").eqNullSafe(F.col("procedure")) & ~none, "implementation and procedure do not diverge"),
        (kind("rule_missed") & ~F.col("procedure").eqNullSafe(F.col("policy")) & ~none, "procedure and policy do not agree"),
        (kind("version_branching") & (F.col("older") + F.col("newer") + F.col("third") < 3), "a version is missing"),
        (kind("newer_not_applicable") & (F.col("older") + F.col("newer") < 2), "a version asserts nothing"),
        (kind("newer_not_applicable") & (F.col("differ") == 0), "the newer version does not differ"),
        (kind("capability_gap") & F.col("versions"), "several versions without version reads"),
    )
    found = F.filter(F.array(*(F.when(broken, name) for broken, name in rules)), lambda x: x.isNotNull())
    return planted.join(seen, "planted", "left").select("planted", "kind", F.explode(found).alias("problem"))


#: Kinds in the order in which part sizes stand for them.
SPAN_KINDS = ("conflict", "multi_hub_fact", "rule_missed", "version_branching", "newer_not_applicable", "capability_gap", "coverage_gap")


@query(f"""WITH p AS (SELECT p_partkey AS planted, [{", ".join(f"'{k}'" for k in SPAN_KINDS)}][p_partkey % 7 + 1] AS kind FROM part),
s AS (SELECT l_partkey AS planted, l_shipmode AS hub, l_linestatus AS release, l_linenumber AS version, CASE l_returnflag WHEN 'R' THEN 'implemented' WHEN 'A' THEN 'procedure' ELSE 'policy' END AS role, CAST(l_quantity AS BIGINT) // 10 AS value
FROM (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 'a' ELSE 'b' END AS l_shipmode FROM lineitem) WHERE l_orderkey % 5 = 0 AND l_partkey % 2 = 0),
g AS (SELECT planted, kind, count(s.planted) AS n, count(DISTINCT value) FILTER (release = 'F') AS now, count(DISTINCT hub) AS hubs, min(value) FILTER (role = 'implemented') AS i, min(value) FILTER (role = 'procedure') AS pr, min(value) FILTER (role = 'policy') AS po,
count(DISTINCT version) FILTER (version IN (1, 2, 3)) AS v3, count(DISTINCT version) FILTER (version IN (1, 2)) AS v2, list_sort(list(DISTINCT value) FILTER (version = 1)) IS DISTINCT FROM list_sort(list(DISTINCT value) FILTER (version = 2)) AS differ, count(DISTINCT version) AS vs
FROM p LEFT JOIN s USING (planted) GROUP BY planted, kind)
SELECT planted, kind, 'no artifact shows it' AS problem FROM g WHERE n = 0 AND kind <> 'coverage_gap' UNION ALL SELECT planted, kind, 'sources do not disagree' FROM g WHERE n > 0 AND kind = 'conflict' AND now < 2
UNION ALL SELECT planted, kind, 'not in two hubs' FROM g WHERE n > 0 AND kind = 'multi_hub_fact' AND hubs < 2 UNION ALL SELECT planted, kind, 'implementation and procedure do not diverge' FROM g WHERE n > 0 AND kind = 'rule_missed' AND i IS NOT DISTINCT FROM pr
UNION ALL SELECT planted, kind, 'procedure and policy do not agree' FROM g WHERE n > 0 AND kind = 'rule_missed' AND pr IS DISTINCT FROM po UNION ALL SELECT planted, kind, 'a version is missing' FROM g WHERE n > 0 AND kind = 'version_branching' AND v3 < 3
UNION ALL SELECT planted, kind, 'a version asserts nothing' FROM g WHERE n > 0 AND kind = 'newer_not_applicable' AND v2 < 2 UNION ALL SELECT planted, kind, 'the newer version does not differ' FROM g WHERE n > 0 AND kind = 'newer_not_applicable' AND NOT differ
UNION ALL SELECT planted, kind, 'several versions without version reads' FROM g WHERE n > 0 AND kind = 'capability_gap' AND vs > 1""")
def planted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as planted situations, lines of every fifth order of even parts as what is rendered of them; the rest is missing from the build."""
    kind = F.element_at(F.array(*map(F.lit, SPAN_KINDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    planted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("planted"), kind.alias("kind"))
    role = F.when(F.col("l_returnflag") == "R", "implemented").when(F.col("l_returnflag") == "A", "procedure").otherwise("policy")
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0 AND l_partkey % 2 = 0")
    hub = F.when(F.col("l_suppkey") % 3 == 0, "a").otherwise("b")
    return span_problems(planted, lines.select(F.col("l_partkey").alias("planted"), hub.alias("hub"), F.col("l_linestatus").alias("release"), F.col("l_linenumber").alias("version"), role.alias("role"), F.expr("cast(l_quantity as bigint) div 10").alias("value")))


def text_problems(planted: DataFrame, rows: DataFrame) -> DataFrame:
    """(planted, kind, problem) of situations (planted, kind, hub, place, phrase) that should show in texts of rows (hub, place, acl, text).

    homonym, hub_name and injection: the phrase stands in a text of the hub. restricted: the place has rows, each with an acl, and the
    phrase, a canary, stands in one of them. Situations are an authored list; they meet the rows of their own hub only.
    """
    here = (F.col("kind") != "restricted") | F.col("r.place").eqNullSafe(F.col("p.place"))
    met = planted.alias("p").join(rows.alias("r"), (F.col("p.hub") == F.col("r.hub")) & here)
    seen = met.groupBy("p.planted").agg(F.bool_or(F.contains("r.text", "p.phrase")).alias("shown"), F.bool_or(F.coalesce(F.size("r.acl"), F.lit(0)) <= 0).alias("open"))
    none, locked = F.col("shown").isNull() & F.col("open").isNull(), F.col("kind") == "restricted"
    rules = (
        (locked & none, "no rows in the place"),
        (locked & F.col("open"), "a row of the place has no acl"),
        (locked & ~F.coalesce("shown", F.lit(False)), "canary not in the place"),
        (~locked & ~F.coalesce("shown", F.lit(False)), "phrase not in the hub"),
    )
    found = F.filter(F.array(*(F.when(broken, name) for broken, name in rules)), lambda x: x.isNotNull())
    return planted.join(seen, "planted", "left").select("planted", "kind", F.explode(found).alias("problem"))


_PLANTED = """b AS (SELECT item_id AS planted, ['homonym', 'hub_name', 'injection', 'restricted'][item_id % 4 + 1] AS kind, 'src' || item_id % 21 AS hub, ['de', 'en', 'it'][item_id % 3 + 1] AS place, split_part(text, ' ', 3) AS phrase FROM benchmark)"""


@query(f"""WITH {_PLANTED}, m AS (SELECT planted, kind, count(doc_id) AS n, coalesce(bool_or(contains(text, phrase)), false) AS shown, coalesce(bool_or(doc_id % 31 = 0), false) AS open FROM b LEFT JOIN documents d ON d.source = hub AND (kind <> 'restricted' OR lang = place) GROUP BY ALL)
SELECT planted, kind, 'no rows in the place' AS problem FROM m WHERE kind = 'restricted' AND n = 0 UNION ALL SELECT planted, kind, 'a row of the place has no acl' FROM m WHERE kind = 'restricted' AND open
UNION ALL SELECT planted, kind, 'canary not in the place' FROM m WHERE kind = 'restricted' AND NOT shown UNION ALL SELECT planted, kind, 'phrase not in the hub' FROM m WHERE kind <> 'restricted' AND NOT shown""")
def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as planted situations (their third word is the phrase), documents as rows of their source, one in 31 without an acl."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.col("item_id") % i + 1).cast("int"))
    hub = F.concat(F.lit("src"), (F.col("item_id") % 21).cast("string"))
    phrase = F.split_part("text", F.lit(" "), F.lit(3))
    planted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("planted"), pick(("homonym", "hub_name", "injection", "restricted"), 4).alias("kind"), hub.alias("hub"), pick(("de", "en", "it"), 3).alias("place"), phrase.alias("phrase"))
    acl = F.when(F.col("doc_id") % 31 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return text_problems(planted, table(spark, sf_dir, "documents").select(F.col("source").alias("hub"), F.col("lang").alias("place"), acl.alias("acl"), "text"))


def copy_problems(copies: DataFrame) -> DataFrame:
    """(planted, problem) of exact duplicates (planted, artifact, hub, version, text): all versions of all copies must agree byte by byte, in two hubs at least."""
    every = copies.groupBy("planted").agg(F.countDistinct("artifact").alias("copies"), (F.min("hub") == F.max("hub")).alias("one"))
    text = F.sha2(F.col("text").cast("binary"), 256).alias("text")
    rows = copies.groupBy("planted", "artifact", "version", text).agg(F.count("*").alias("n"))
    shared = rows.groupBy("planted", "version", "text", "n").agg(F.count("*").alias("having")).groupBy("planted").agg(F.min("having").alias("least"))
    seen = every.join(shared, "planted").select("planted", (F.col("least") < F.col("copies")).alias("differ"), "one")
    found = F.filter(F.array(F.when(F.col("differ"), "copies are not identical"), F.when(F.col("one"), "copies are not in two hubs")), lambda x: x.isNotNull())
    return seen.select("planted", F.explode(found).alias("problem"))


@query("""WITH d AS (SELECT l_partkey % 40 AS planted, l_orderkey AS artifact, CASE WHEN l_partkey % 40 % 2 = 0 THEN 'h' || l_orderkey % 2 ELSE 'h' END AS hub, l_linenumber AS version, l_returnflag AS text FROM lineitem WHERE l_orderkey % 300 = 0),
w AS (SELECT planted, artifact, min(hub) AS hub, string_agg(version || text, ',' ORDER BY version, text) AS t FROM d GROUP BY ALL), g AS (SELECT planted, count(DISTINCT t) > 1 AS differ, count(DISTINCT hub) = 1 AS one FROM w GROUP BY planted)
SELECT planted, 'copies are not identical' AS problem FROM g WHERE differ UNION ALL SELECT planted, 'copies are not in two hubs' FROM g WHERE one""")
def planted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a part stand for copies of one artifact, their lines for versions; every 300th order is rendered."""
    d = table(spark, sf_dir, "lineitem").where("l_orderkey % 300 = 0")
    planted = F.col("l_partkey") % 40
    hub = F.when(planted % 2 == 0, F.concat(F.lit("h"), (F.col("l_orderkey") % 2).cast("string"))).otherwise("h")
    return copy_problems(d.select(planted.alias("planted"), F.col("l_orderkey").alias("artifact"), hub.alias("hub"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("text")))


def foreign_names(declared: DataFrame, mentions: DataFrame) -> DataFrame:
    """(hub, name, mentions): names declared by some hub (hub, name) that a hub which does not declare them mentions (hub, name)."""
    counts = mentions.groupBy("hub", "name").agg(F.count("*").alias("mentions"))
    return counts.join(declared.select("name").distinct(), "name", "left_semi").join(declared.distinct(), ["hub", "name"], "left_anti").select("hub", "name", "mentions")


@query("""WITH d AS (SELECT DISTINCT p_brand AS hub, split_part(p_name, ' ', 2) AS name FROM part WHERE p_size < 4 UNION SELECT p_brand, split_part(p_name, ' ', 1) FROM part WHERE p_size > 48)
SELECT p_brand AS hub, split_part(p_name, ' ', 2) AS name, count(*) AS mentions FROM part p WHERE split_part(p_name, ' ', 2) IN (SELECT name FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.hub = p_brand AND d.name = split_part(p_name, ' ', 2)) GROUP BY ALL""")
def foreign_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as hubs: core names from their small parts, filler names from their large ones; all parts mention a name."""
    part = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i)).alias("name")
    core, filler = part.where("p_size < 4").select(F.col("p_brand").alias("hub"), word(2)), part.where("p_size > 48").select(F.col("p_brand").alias("hub"), word(1))
    return foreign_names(core.unionByName(filler), part.select(F.col("p_brand").alias("hub"), word(2)))


def posting_changes(rows: DataFrame, terms: Column) -> DataFrame:
    """(term, revision, change) of rows (artifact_id, revision, ..): a revision adds its new terms to an index and takes away those of the one before it."""
    own = rows.select("artifact_id", "revision", terms.alias("terms"))
    pairs = last_before(own, ["artifact_id"], ["revision"], F.col("terms"), "was")
    was = F.coalesce("was", F.array().cast("array<string>"))
    signed = lambda a, b, v: F.transform(F.array_except(a, b), lambda t: F.struct(t.alias("term"), F.lit(v).alias("change")))
    changes = F.concat(signed(F.col("terms"), was, 1), signed(was, F.col("terms"), -1))
    return pairs.select("revision", F.explode(changes).alias("c")).groupBy("c.term", "revision").agg(F.sum("c.change").alias("change"))


@query("""WITH l AS (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+')) AS term FROM l) SELECT term, count(*) AS artifacts FROM t GROUP BY term""")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many artifacts hold each term once all revisions are in, kept up by changes; the SQL builds the index anew from the last revisions."""
    terms = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0)))
    changes = posting_changes(versioned_rows(spark, sf_dir), terms)
    return changes.groupBy("term").agg(F.sum("change").alias("artifacts")).where("artifacts > 0")
