"""Files in and out: guarded hub folders, JSON lines with sorted keys, an append-only change log, a run-once log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from evigrid.plans.registry import query
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import table

HUB_ROW = "hub string, acl array<string>, artifact_id string, environment string, kind string, location string, metadata map<string,string>, path string, text string, title string, version string"
CAPABILITY = "hub string, version_reads boolean, filters array<string>, max_results int, principal_scoped boolean, error_semantics string, place_version_reads map<string,boolean>"
CHANGE = "seq bigint, hub string, kind string, subject string, at_revision bigint, principal_scoped boolean"
FILES = ("artifacts.jsonl", "capabilities.json")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark can open; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def check_hub_folder(spark: SparkSession, folder: str) -> str:
    """A hub folder is never below a private one and holds exactly its two files."""
    if "private" in folder.split("/"):
        raise ValueError(f"{folder} is private")
    if [n for n in names_in(spark, folder) if not n.startswith(".")] != sorted(FILES):
        raise ValueError(f"{folder} must hold {' and '.join(FILES)}, and nothing else")
    return folder


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of exactly this schema: blank lines are skipped; broken lines and unknown fields are errors when rows are read."""
    shape = StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    unknown = F.array_except(F.json_object_keys("value"), F.array(*(F.lit(n) for n in shape.fieldNames())))
    bad = F.coalesce(F.size(unknown) > 0, F.lit(True))
    line = F.when(bad, F.raise_error(F.concat(F.lit("not a row of this schema: "), F.col("value"))).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(line, shape, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def hub_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """All revisions of a hub's artifacts with their number and owner; no order is imposed."""
    rows = json_rows(spark, f"{check_hub_folder(spark, folder)}/{FILES[0]}", HUB_ROW)
    revision = F.coalesce(F.try_element_at("metadata", F.lit("revision")).try_cast("int"), F.lit(0))
    return rows.withColumn("revision", revision).withColumn("owner", F.try_element_at("metadata", F.lit("principal")))


def hub_capabilities(spark: SparkSession, folder: str) -> DataFrame:
    """A hub's contract, one row."""
    return json_rows(spark, f"{check_hub_folder(spark, folder)}/{FILES[1]}", CAPABILITY)


def reads_versions(place: str) -> Column:
    """Whether a place keeps versions: the hub's no outranks, a place that isn't named counts as yes."""
    return F.col("version_reads") & F.coalesce(F.try_element_at("place_version_reads", F.lit(place)), F.lit(True))


def _sorted(column: Column, shape) -> Column:
    if isinstance(shape, StructType):
        inner = F.struct(*(_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(shape.fields, key=lambda f: f.name)))
        return F.when(column.isNotNull(), inner)
    if isinstance(shape, ArrayType) and isinstance(shape.elementType, StructType):
        return F.transform(column, lambda x: _sorted(x, shape.elementType))
    return column


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a row, keys sorted at every level, nulls written out: equal rows are equal bytes."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    rows.select(F.to_json(F.struct(*(_sorted(F.col(f.name), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_changes(log: str, events: DataFrame) -> DataFrame:
    """Numbers events (without seq) on from the log's last number and adds them, as one part of the log; gives the added rows back.

    A log has one writer. events carries an ordinal column "at", by which they are numbered.
    """
    from evigrid.operators.changes import numbered

    spark = events.sparkSession
    last = change_log(spark, log).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = numbered(events.withColumn("ts", F.col("at")).withColumn("event_id", F.col("at"))).withColumn("seq", F.col("seq") + last)
    part = f"{log}/{uuid.uuid4().hex}"
    write_json_lines(rows.select("seq", *(c for c in StructType.fromDDL(CHANGE).fieldNames() if c != "seq")), part)
    return json_rows(spark, part, CHANGE)


def change_log(spark: SparkSession, log: str, after: int = 0) -> DataFrame:
    """Raw events after a cursor."""
    if not names_in(spark, log):
        return spark.createDataFrame([], CHANGE)
    return json_rows(spark, f"{log}/*", CHANGE).where(F.col("seq") > after)


RUN = "milestone string, config string, status string, reason string"


def claim_run(spark: SparkSession, log: str, milestone: str, config: str, force: bool = False, reason: str | None = None) -> None:
    """Refuses a second run of what already ran well, unless forced with a reason."""
    done = names_in(spark, log) and not json_rows(spark, f"{log}/*", RUN).where((F.col("milestone") == milestone) & (F.col("config") == config) & (F.col("status") == "ok")).isEmpty()
    if done and not (force and reason):
        raise ValueError(f"{milestone} of {config} has run; force it with a reason")


def record_run(spark: SparkSession, log: str, milestone: str, config: str, status: str, reason: str | None = None) -> None:
    write_json_lines(spark.createDataFrame([(milestone, config, status, reason)], RUN), f"{log}/{uuid.uuid4().hex}")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines with sorted keys, and read back by schema."""
    path = shared_folder(spark)
    write_json_lines(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return json_rows(spark, path, "conv_id bigint, turn bigint, role string, text string")
