"""What runs and builds leave behind: rendered hubs with a manifest, run folders, schema snapshots, canned answers, exchanges."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

from evigrid.plans.registry import query
from evigrid.sources.files import json_rows, names_in, write_json_lines
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import table

# Names of fields that hold credentials.
CREDENTIALS = "authorization api_key apikey token secret password".split()


def manifest(rows: DataFrame, hub: str, text: str) -> DataFrame:
    """(hub, rows, digest): counts and an order-free digest of contents, as the sum of their hashes' first 32 bits."""
    h = F.conv(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(F.col(hub).alias("hub")).agg(F.count("*").alias("rows"), F.sum(h).alias("digest"))


def render(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (hub and further columns) as JSON lines, a folder for each hub, over whatever was there; gives the manifest of what was written.

    Rows are dealt by hub and a hash of the row, so that a large hub is written by many tasks and a small one leaves few files.
    """
    spark, fields = rows.sparkSession, [c for c in rows.columns if c != "hub"]
    lines = rows.select("hub", F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("value"))
    lines.repartition("hub", F.pmod(F.xxhash64("value"), F.lit(16))).write.mode("overwrite").partitionBy("hub").text(folder)
    return manifest(spark.read.schema("value string, hub string").text(folder), "hub", "value")


def write_run(folder: str, run_id: str, relations: dict[str, DataFrame], options: dict[str, str]) -> None:
    """A run's relations as Parquet, then its manifest: options, schemas and counts. Without a manifest a run isn't whole; a whole one is never written over."""
    spark, path = next(iter(relations.values())).sparkSession, f"{folder}/{run_id}"
    if "manifest" in names_in(spark, path):
        raise ValueError(f"run {run_id} has been written")
    rows = []
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((run_id, name, spark.read.parquet(f"{path}/{name}").count(), df.schema.json(), json.dumps(options, sort_keys=True)))
    write_json_lines(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{path}/manifest")


MANIFEST = "run_id string, relation string, rows bigint, schema string, options string"


def read_run(spark: SparkSession, folder: str, run_id: str, relation: str, schema: StructType) -> DataFrame:
    """A relation of a run; a missing one is empty, one of another shape than its manifest or the schema says is refused."""
    path = f"{folder}/{run_id}"
    if "manifest" not in names_in(spark, path):
        raise ValueError(f"run {run_id} is not whole")
    known = json_rows(spark, f"{path}/manifest", MANIFEST).where(F.col("relation") == relation).first()
    if known is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{path}/{relation}")
    unchanged(rows, known["schema"])
    return rows.select(*schema.fieldNames())


def unchanged(rows: DataFrame, snapshot: str) -> None:
    """Refuses rows whose columns and types are not those of a schema snapshot (StructType.json())."""
    want, have = (sorted((f.name, f.dataType.simpleString()) for f in s.fields) for s in (StructType.fromJson(json.loads(snapshot)), rows.schema))
    if want != have:
        raise ValueError(f"the schema is {have}, the snapshot has {want}")


def canned(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request (request_id) with its canned response; a request without one has a null response."""
    return requests.join(responses.select("request_id", F.struct(*(c for c in responses.columns if c != "request_id")).alias("response")), "request_id", "left")


def store_exchanges(exchanges: DataFrame, folder: str) -> None:
    """Appends raw exchanges (request_id, round, body: JSON) to a store; a field that could hold a credential is left out at every level.

    Bodies of one store differ in their fields, so each is parsed by itself, in batches; one that is no JSON object is stored as null.
    """
    exchanges.select("request_id", "round", _without_credentials("body").alias("body")).write.mode("append").parquet(folder)


@pandas_udf(StringType())
def _without_credentials(bodies: pd.Series) -> pd.Series:
    def kept(value):
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if k.lower() not in CREDENTIALS}
        return [kept(v) for v in value] if isinstance(value, list) else value

    def one(body: str | None) -> str | None:
        try:
            value = json.loads(body or "null")
        except ValueError:
            return None
        return json.dumps(kept(value), separators=(",", ":")) if isinstance(value, dict) else None

    return bodies.map(one)


def write_markdown(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A table for readers, in the order of rows, as one Markdown file; null is a dash. It is for summaries: more than `most` rows are refused."""
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in rows.columns]
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    if len(found := body.head(most + 1)) > most:
        raise ValueError(f"a report's table has {most} rows at most; write larger ones as JSON lines")
    lines = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns), *(r["value"] for r in found)]
    rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one file's lines, from 1."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("i", "text")).select((F.col("i") + 1).cast("bigint").alias("line"), "text")


@query("SELECT source AS hub, count(*) AS rows, sum(CAST('0x' || left(sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}'), 8) AS BIGINT))::BIGINT AS digest FROM documents GROUP BY source")
def rendered_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' ids and languages rendered by source, and the manifest of the files."""
    return render(table(spark, sf_dir, "documents").select(F.col("source").alias("hub"), "doc_id", "lang"), shared_folder(spark))
