"""Who and what a request is about: signed claims, pinned releases, identity signatures, arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import text as X
from evigrid.plans.registry import query
from evigrid.sources.tables import calls, table

#: The example's signing key; a service reads its own from its configuration.
EXAMPLE_KEY = b"example"


def _pads(key: bytes) -> tuple[bytes, bytes]:
    """The two padded keys of HMAC; a key of up to 64 bytes."""
    if len(key) > 64:
        raise ValueError("keys of more than 64 bytes are hashed first")
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(payload: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a string, in hex."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), payload.cast("binary")), 256))), 256)


def signed(claims: Column, key: bytes) -> Column:
    """A token: the claims (JSON) in base64 for urls, a point, the signature."""
    body = F.rtrim(F.translate(F.base64(claims.cast("binary")), "+/", "-_"), F.lit("="))
    return F.concat(body, F.lit("."), signature(body, key))


def verdict(token: Column, key: bytes, audience: Column, now: Column) -> Column:
    """ok, or why a token is refused: its signature, its audience, its expiry. Claims of a wrong signature are not looked at."""
    body, given = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    claims = F.unbase64(F.translate(body, "-_", "+/")).cast("string")
    wrong = F.get_json_object(claims, "$.aud") != audience
    late = F.get_json_object(claims, "$.exp").cast("bigint") < now
    return F.when(signature(body, key) != given, "bad_signature").when(wrong, "wrong_audience").when(late, "expired").otherwise("ok")


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


_SQL_BODY = """rtrim(translate(to_base64(encode('{"sub":' || user_id || ',"aud":"' || event_type || '","exp":' || (event_id % 100) || '}')), '+/', '-_'), '=')"""


@query(f"SELECT event_id AS call_id, sha256({_blob(_pads(EXAMPLE_KEY)[1])} || unhex(sha256({_blob(_pads(EXAMPLE_KEY)[0])} || encode(body)))) AS signature, CASE WHEN event_id % 7 = 0 THEN 'bad_signature' WHEN event_type <> 'click' THEN 'wrong_audience' WHEN event_id % 100 < 50 THEN 'expired' ELSE 'ok' END AS verdict FROM (SELECT *, {_SQL_BODY} AS body FROM events)")
def signed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of calls, one in seven tampered with, at a hub for clicks at time 50."""
    claims = F.concat(F.lit('{"sub":'), F.col("request_id"), F.lit(',"aud":"'), F.col("source_id"), F.lit('","exp":'), F.col("call_id") % 100, F.lit("}"))
    rows = calls(spark, sf_dir).select("call_id", signed(claims, EXAMPLE_KEY).alias("token"))
    given = F.when(F.col("call_id") % 7 == 0, F.concat("token", F.lit("0"))).otherwise(F.col("token"))
    return rows.select("call_id", F.split_part("token", F.lit("."), F.lit(2)).alias("signature"), verdict(given, EXAMPLE_KEY, F.lit("click"), F.lit(50)).alias("verdict"))


@query("WITH p AS (SELECT user_id, CAST(date_trunc('day', min(ts)) AS DATE) AS release FROM events GROUP BY user_id) SELECT event_id AS call_id, release, CAST(date_trunc('day', ts) AS DATE) <> release AS outdated FROM events JOIN p USING (user_id)")
def pinned_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of a request read the release that was current at its first call, whatever was released since (a release a day)."""
    rows = calls(spark, sf_dir).select("call_id", "request_id", F.to_date("ts").alias("day"))
    pin = rows.groupBy("request_id").agg(F.min("day").alias("release"))
    return rows.join(pin, "request_id").select("call_id", "release", (F.col("day") != F.col("release")).alias("outdated"))


_DOMAIN = ("large", "small", "red", "blue")


@query(f"""WITH t AS (SELECT p_partkey, p_brand, list_filter({X.sql_words("p_name")}, lambda w: w NOT IN ({X.SQL_STOPWORDS})) AS ws, list_filter({X.sql_words("p_type")}, lambda w: w NOT IN ({X.SQL_STOPWORDS})) AS vs FROM part),
s AS (SELECT p_partkey, list_concat(list_concat(list_transform(ws, lambda w: {X.sql_stem("w")}), list_transform(vs, lambda w: {X.sql_stem("w")})), list_concat(CASE WHEN len(ws) > 1 THEN [array_to_string(list_transform(ws, lambda w: left(w, 1)), '')] ELSE [] END, CASE WHEN len(vs) > 1 THEN [array_to_string(list_transform(vs, lambda w: left(w, 1)), '')] ELSE [] END)) AS sig FROM t)
SELECT p_partkey AS unit, array_to_string(list_sort(list_distinct(list_filter(sig, lambda w: w NOT IN {_DOMAIN}))), ',') AS identity FROM s""")
def identity_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that name what a unit is about: stems of its names and the acronyms of those of several words, without the domain's own words."""

    def of(name: str) -> Column:
        ws = F.filter(X.words(F.col(name)), lambda w: ~w.isin(X.STOPWORDS))
        acronym = F.when(F.size(ws) > 1, F.array(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(ws, X.stem), acronym)

    kept = F.filter(F.array_distinct(F.concat(of("p_name"), of("p_type"))), lambda w: ~w.isin(*_DOMAIN))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.array_join(F.array_sort(kept), ",").alias("identity"))


#: What each switch of an arm may be set to.
SWITCHES = {"memory": ("none", "flat", "graph"), "decisions": ("none", "standin"), "packing": ("prefix", "reserved")}


@query("SELECT n_name AS arm, CASE WHEN n_regionkey = 0 THEN 'memory' WHEN n_regionkey = 1 THEN 'decisions' WHEN n_regionkey = 2 THEN 'packing' ELSE 'colour' END AS switch, CASE WHEN n_regionkey > 2 THEN 'unknown switch' WHEN n_nationkey % 2 = 1 AND n_regionkey <> 2 THEN 'unknown value' WHEN n_nationkey % 2 = 0 AND n_regionkey = 2 THEN 'unknown value' ELSE 'ok' END AS problem FROM nation")
def validated_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of arms against the switches that exist and the values that they have."""
    known = F.create_map(*(x for k, v in SWITCHES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    switch = F.get(F.array(*map(F.lit, SWITCHES)), F.col("n_regionkey").cast("int"))
    value = F.when(F.col("n_nationkey") % 2 == 0, "none").otherwise("reserved")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("arm"), F.coalesce(switch, F.lit("colour")).alias("switch"), value.alias("value"))
    values = F.try_element_at(known, F.col("switch"))
    problem = F.when(values.isNull(), "unknown switch").when(~F.array_contains(values, F.col("value")), "unknown value").otherwise("ok")
    return rows.select("arm", "switch", problem.alias("problem"))
