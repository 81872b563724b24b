"""Declared inputs, one YAML (or JSON) file each: cases, questions, worlds with overlays, registries, memory releases, readers, providers, filler, templates.

Files are read and parsed where Spark's tasks are; what is checked is an aggregate or a join, and what is refused is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.sources.files import HUB_ROW, json_rows, names_in


def _as_json(text: str) -> str:
    """YAML as JSON; without a YAML library, JSON is the part of it that can be read."""
    try:
        from yaml import safe_load
    except ImportError:
        safe_load = json.loads
    return json.dumps(safe_load(text), default=str)


def documents(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """(file, columns of the schema): one row a file. A file of another shape, or with an unknown field, is an error when it is read."""

    @F.pandas_udf("string")
    def parsed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(_as_json)

    files = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), parsed("value").alias("value"))
    known = spark.createDataFrame([], schema).schema
    unknown = F.array_except(F.json_object_keys("value"), F.array(*(F.lit(n) for n in known.fieldNames())))
    bad = F.coalesce(F.size(unknown) > 0, F.lit(True))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not of this schema: "), F.col("file"))).cast("string")).otherwise(F.col("value"))
    return files.select("file", F.from_json(checked, known, {"mode": "FAILFAST"}).alias("r")).select("file", "r.*")


def refuse(rows: DataFrame, why: str) -> None:
    """An error that names one of the rows, if there is any."""
    if row := rows.head():
        raise ValueError(f"{why}: {row.asDict(True)}")


def build_rows(spark: SparkSession, build: str) -> DataFrame:
    """All hubs' artifact rows of a build; a row's hub must be its folder's."""
    rows = json_rows(spark, f"{build}/hubs/*/artifacts.jsonl", HUB_ROW)
    refuse(rows.where(F.col("hub").isNull()).select("artifact_id"), "rows without a hub")
    folders = spark.createDataFrame([(n,) for n in names_in(spark, f"{build}/hubs")], "hub string")
    refuse(rows.select("hub").distinct().join(F.broadcast(folders), "hub", "left_anti"), "rows of a hub without a folder")
    return rows


QUESTION = "id string, family string, principal string, text string, mode string, scope string, as_of string, environment string, entities array<string>, name struct<native:string,hub:string,namespace:string>, budget_tokens int, deadline_ms int"


def questions(spark: SparkSession, pattern: str) -> DataFrame:
    """Question specs, with defaults of budget and deadline: each names entities or a native name, never both."""
    rows = documents(spark, pattern, QUESTION)
    refuse(rows.where((F.coalesce(F.size("entities"), F.lit(0)) > 0) == F.col("name").isNotNull()).select("file", "id"), "exactly one of entities and name")
    return rows.withColumns({"budget_tokens": F.coalesce("budget_tokens", F.lit(4000)), "deadline_ms": F.coalesce("deadline_ms", F.lit(3000))})


def principals(spark: SparkSession, pattern: str) -> DataFrame:
    """(principal, groups), groups sorted."""
    rows = documents(spark, pattern, "principals map<string,array<string>>")
    return rows.select(F.explode("principals").alias("principal", "groups")).select("principal", F.array_sort("groups").alias("groups"))


def with_overlays(world: DataFrame, *overlays: DataFrame) -> DataFrame:
    """A world's list with those of its overlays appended; an overlay of another shape is refused."""
    for other in overlays:
        if set(other.columns) != set(world.columns):
            raise ValueError(f"an overlay may only append rows of {world.columns}, not {other.columns}")
        world = world.unionByName(other)
    return world


MANIFEST = "hub_id string, evidence_kind string, role string, authority map<string,string>, places array<struct<prefix:string,groups:array<string>,domain:string>>, procedures array<struct<trigger:string,must_consult:array<string>>>, domains map<string,array<string>>"


def registry(spark: SparkSession, pattern: str) -> tuple[DataFrame, str]:
    """The owners' manifests and their version, a digest over names and contents.

    A hub that is declared twice, and a procedure that must consult a hub nobody declares, are refused.
    """
    rows = documents(spark, pattern, MANIFEST)
    refuse(rows.groupBy("hub_id").count().where("count > 1 OR hub_id IS NULL"), "a hub is declared once")
    must = rows.select(F.explode("procedures").alias("p")).select(F.explode("p.must_consult").alias("hub_id")).distinct()
    refuse(must.join(rows.select("hub_id"), "hub_id", "left_anti"), "must consult a hub that is not declared")
    contents = spark.read.text(pattern, wholetext=True).select(F.sha2(F.concat_ws("\u001f", F.element_at(F.split("_metadata.file_path", "/"), -1), "value").cast("binary"), 256).alias("h"))
    version = contents.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]  # one digest a file
    return rows, version


RELEASE = "id string, entities array<struct<id:string,ref:string,type:string,label:string,member_of:array<string>>>, terms array<struct<source:string,native_id:string,label:string,denotes:string,status:string,version:string>>"


def memory_release(spark: SparkSession, folder: str, release: str | None = None) -> DataFrame:
    """One release of the memory, by name or by the folder's ACTIVE file. Its id is its folder's name; terms and memberships point to its entities."""
    name = release or spark.read.text(f"{folder}/ACTIVE").where(F.trim("value") != "").first()[0].strip()
    rows = documents(spark, f"{folder}/{name}/release.yaml", RELEASE)
    refuse(rows.where(~F.col("id").eqNullSafe(F.lit(name))).select("id"), f"not the release {name}")
    own = rows.select(F.explode("entities").alias("e")).select("e.*")
    wanted = own.select(F.explode("member_of").alias("id")).unionByName(rows.select(F.explode("terms").alias("t")).select(F.col("t.denotes").alias("id")).where("id IS NOT NULL"))
    refuse(wanted.distinct().join(own.select("id"), "id", "left_anti"), "a reference to no entity of the release")
    return rows


_SPANS = "struct<spans:array<struct<source_id:string,artifact_id:string,version:string,start:int,end:int>>>"
CASE = (
    "case_id string, bundle_id string, family string, principal string, scenario_script string, answerable boolean, interpretation_policy string, "
    "request struct<request_id:string,query:string,mode:string,scope:string,as_of:string,environment:string,budget_tokens:int,deadline_ms:int,caller_profile:string>, "
    "interpretations array<struct<interpretation_id:string,entity_ref:string>>, "
    f"obligations array<struct<obligation_id:string,interpretation_id:string,weight:double,obtainable:boolean,acceptable_gap_reasons:array<string>,bundles:array<{_SPANS}>>>, "
    "source_obligations array<struct<source_id:string,mandatory:boolean,expected:string,substitutes:array<string>>>, "
    f"relations array<struct<relation_id:string,relation_type:string,witness_a:{_SPANS},witness_b:{_SPANS}>>, "
    "forbidden struct<canaries:array<string>,wrong_entities:array<string>,prohibited_activations:array<string>>, "
    "expected struct<evidence_status:string,required_reasons:array<string>,source_status:map<string,string>>"
)


def cases(spark: SparkSession, *patterns: str) -> DataFrame:
    """Expected results, one file a case, from several folders together; lists that a case leaves out are empty, an obligation is obtainable unless it says no.

    Refused are: two files of one name; an obligation of an unknown interpretation, without weight or bundle; alternatives of
    fewer than two interpretations; a request id that tells the case.
    """
    rows = reduce(DataFrame.unionByName, (documents(spark, p, CASE) for p in patterns))
    refuse(rows.groupBy("file").count().where("count > 1"), "two case files of one name")
    lists = ("interpretations", "obligations", "source_obligations", "relations")
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in lists})
    rows = rows.withColumn("obligations", F.transform("obligations", lambda o: o.withField("obtainable", F.coalesce(o["obtainable"], F.lit(True)))))
    known = F.transform("interpretations", lambda i: i["interpretation_id"])
    bad = F.exists("obligations", lambda o: ~F.coalesce(F.array_contains(known, o["interpretation_id"]) & (o["weight"] > 0) & (F.size(o["bundles"]) > 0), F.lit(False)))
    few = (F.col("interpretation_policy") == "separate_alternatives") & (F.size(F.array_distinct(known)) < 2)
    tells = F.coalesce(F.contains("request.request_id", "case_id"), F.lit(True))
    why = F.when(bad, "an obligation without interpretation, weight or bundle").when(few, "alternatives of one interpretation").when(tells, "the request id tells the case")
    refuse(rows.select("file", why.alias("why")).where("why IS NOT NULL"), "not a case")
    return rows


FILLER = "services array<struct<key:string,domain:string,repo:string,skill_name:string,doc_space:string,memory_name:string>>, artifact_counts map<string,int>, kinds map<string,array<string>>, version_refs map<string,array<string>>, words array<string>, bodies map<string,array<string>>, titles map<string,array<string>>, noise_sentences array<string>"


def filler_dictionary(spark: SparkSession, pattern: str, schema: str = FILLER) -> DataFrame:
    """The dictionary that filler is made of, one row: at least one service and three sentences of noise."""
    rows = documents(spark, pattern, schema)
    refuse(rows.where(~F.coalesce((F.size("services") > 0) & (F.size("noise_sentences") > 2), F.lit(False))).select("file"), "a service and three sentences of noise are needed")
    return rows


def filler_natives(dictionary: DataFrame) -> DataFrame:
    """(hub, native): the names that each hub has for the dictionary's services."""
    # Which of a service's names each hub uses.
    names = {"codehub": "repo", "skillhub": "skill_name", "dochub": "doc_space", "memoryhub": "memory_name"}
    service = dictionary.select(F.explode("services").alias("s"))
    return service.select(F.explode(F.array(*(F.struct(F.lit(h).alias("hub"), F.col(f"s.{n}").alias("native")) for h, n in names.items()))).alias("n")).select("n.*").distinct()


_CAPABILITIES = "struct<primitives:array<string>,max_questions_per_call:int,max_options:int,max_state_chars:int,batching:boolean,reports_usage:boolean,hosted:boolean,data_classes_allowed:array<string>,conformance:string,confidence_thresholdable:boolean>"
PROVIDERS = f"providers map<string,struct<kind:string,base_url_env:string,base_url:string,model_env:string,model:string,api_key_env:string,timeout_retry:int,capabilities:{_CAPABILITIES},notes:string>>"


def providers(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, kind, model, ..., capabilities), what is left out by default: keys and addresses are names of variables, never values.

    More than one retry after a timeout, or a limit that is not above 0, is refused.
    """
    rows = documents(spark, pattern, PROVIDERS).select(F.explode("providers").alias("name", "p")).select("name", "p.*")
    # What a provider can do unless it says otherwise.
    limits = {"max_questions_per_call": F.lit(20), "max_options": F.lit(20), "max_state_chars": F.lit(20000)}
    flags = {"batching": F.lit(True), "reports_usage": F.lit(False), "hosted": F.lit(False), "confidence_thresholdable": F.lit(False)}
    others = {"primitives": F.array(F.lit("noul")), "data_classes_allowed": F.array(F.lit("synthetic")), "conformance": F.lit("experimental")}
    filled = F.struct(*(F.coalesce(F.col("capabilities")[k], v).alias(k) for k, v in (limits | flags | others).items()))
    rows = rows.withColumns({"capabilities": filled, "timeout_retry": F.coalesce("timeout_retry", F.lit(1))})
    wrong = ~F.col("timeout_retry").between(0, 1) | (F.least(*(F.col("capabilities")[k] for k in limits)) <= 0) | F.col("kind").isNull()
    refuse(rows.where(wrong).select("name"), "a provider out of its bounds")
    return rows


def templates(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (hub, kind) with the text of folder/<hub>/<kind>.*, or else folder/shared/<kind>.*; one that is in neither is an error."""
    parts = F.split("_metadata.file_path", "/")
    files = spark.read.text(f"{folder}/*/*", wholetext=True).select(F.element_at(parts, -2).alias("hub"), F.regexp_replace(F.element_at(parts, -1), r"\..*$", "").alias("kind"), F.col("value").alias("text"))
    shared = files.where("hub = 'shared'").select("kind", F.col("text").alias("common"))
    rows = wanted.join(files, ["hub", "kind"], "left").join(shared, "kind", "left").select("hub", "kind", F.coalesce("text", "common").alias("text"))
    refuse(rows.where("text IS NULL").select("hub", "kind"), "no template")
    return rows
