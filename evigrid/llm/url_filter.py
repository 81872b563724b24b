"""URL filters by rules, with blocks carried over to aliases: pages joined by redirects and canonical links.

Only DataFrame operations: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import table
from evigrid.llm.graph import components

#: Fixed rules of the query: verdict, then host and path start.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules go into the plan as literals; more than so many are refused.
MOST_RULES = 5000

# Tags first, then what they hold: each pattern goes over a tag once, however long it is.
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_IS_CANONICAL, _IS_REFRESH = r"(?is)(?<![-\w])rel\s*=\s*[\x22']?\s*canonical\b", r"(?is)(?<![-\w])http-equiv\s*=\s*[\x22']?\s*refresh\b"
_HREF = r"(?is)(?<![-\w])href\s*=\s*(?:\x22([^\x22>]*)\x22|'([^'>]*)'|([^\s>\x22']+))"
_REFRESH = r"(?is)(?<![-\w])content\s*=\s*[\x22']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\x22']?([^\s\x22'>]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    """What follows the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name of a page in the alias graph: host, path and query; scheme and fragment make no difference. Null without "://"."""
    rest = _after(url)
    return F.when(F.length(host_of(url)) > 0, F.concat(host_of(url), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or one above it and the path's start; null if none.

    Of equal rules with both verdicts, allow wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0] == "allow")):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _tags(tag: str, kind: str) -> Column:
    return F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes joined by a canonical link or a refresh in the page's html. Relative targets are taken on the page's own host."""
    rows = pages.where(F.coalesce(F.col("html").rlike(r"(?i)canonical|http-equiv"), F.lit(False))).select("url", "html")
    found = rows.select(
        node_of(F.col("url")).alias("a"),
        host_of(F.col("url")).alias("host"),
        F.regexp_extract(path_of(F.col("url")), r"^(.*/)?", 0).alias("folder"),
        F.concat(
            F.transform(_tags(_LINK, _IS_CANONICAL), lambda t: F.concat(*(F.regexp_extract(t, _HREF, i) for i in (1, 2, 3)))),
            F.transform(_tags(_META, _IS_REFRESH), lambda t: F.regexp_extract(t, _REFRESH, 1)),
        ).alias("targets"),
    )
    found = found.select("a", "host", "folder", F.explode("targets").alias("to")).where("a IS NOT NULL AND to <> ''")
    target = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    before = F.when(F.instr(target, "://") > 0, "").when(target.startswith("//"), "http:").when(target.startswith("/"), F.concat(F.lit("http://"), "host")).otherwise(F.concat(F.lit("http://"), "host", "folder"))
    return found.select("a", F.concat(before, target).alias("to")).select("a", node_of(F.col("to")).alias("b")).where("b IS NOT NULL AND a <> b")


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for each row of pages (page_id, url, html).

    A page's own longest rule decides. A page without one takes part in its alias component, the pages reachable over
    redirect edges (redirects: from_url, to_url) and links of the html: if any url of the component has an allowing rule,
    the verdict is allow (explicit allow goes before block); else, if any has a blocking rule, block; else allow.
    Urls that appear only as targets count too. alias_of is the component's least node, null for a page with no alias.
    A null url or one without "://" has empty host and path and no aliases; a null html has no links; repeated rows are judged alike.
    """
    has_html = "html" in pages.columns
    edges = links(pages) if has_html else None
    if redirects is not None:
        own = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        edges = own if edges is None else edges.unionByName(own)
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    out = ["page_id", "host", "path", F.col("own.rule").alias("rule")]
    if edges is None:
        return rows.select(*out, F.coalesce("own.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    group = components(edges)
    named = group.withColumn("as_url", F.concat(F.lit("http://"), F.col("node")))
    verdicts = named.select("node", "component", best_rule(host_of(F.col("as_url")), path_of(F.col("as_url")), rules)["verdict"].alias("v"))
    decided = verdicts.groupBy("component").agg(F.when(F.coalesce(F.bool_or(F.col("v") == "allow"), F.lit(False)), "allow").when(F.coalesce(F.bool_or(F.col("v") == "block"), F.lit(False)), "block").alias("carried"))
    alias = group.join(decided, "component").select("node", F.col("component").alias("alias_of"), "carried")
    return rows.join(alias, "node", "left").select(*out, F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"), "alias_of")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by the five fixed rules."""
    return judged(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(rule, rh, rp, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_of FROM b
"""
