"""Hubs and change logs as data sources of Spark: format("hub") with a partition for each file of a hub, and a stream of format("changes") with offsets.

Both are registered by register(). Filters on hub and artifact_id are pushed into the hub source: other hubs' files are not opened, other artifacts' lines
make no rows. Folders are read through Arrow's file systems, by the URI that Spark has (local, HDFS, S3 and others).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from evigrid.operators.changes import numbered
from evigrid.plans.registry import query
from evigrid.sources.files import write_json_lines
from evigrid.sources.runs import render
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import table

ROW = "hub string, artifact_id string, revision int, acl array<string>, owner string, location string, text string, title string"
CHANGE = "seq long, hub string, kind string, subject string"
#: Rows of a batch that a reader hands over.
BATCH = 4096


def _opened(path: str):
    """(file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, str]]:
    """(folder, file) of all data files one or two levels below a folder; a folder below a private one is refused."""
    from pyarrow import fs

    system, root = _opened(path)
    if "private" in root.split("/"):
        raise ValueError(f"{path} is private")
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [(f.removeprefix(root.rstrip("/") + "/").split("/")[0], f) for f in inner]


def _lines(path: str, file: str) -> Iterator[dict]:
    """The JSON objects of a file; blank lines are skipped, a broken one is an error."""
    system, _ = _opened(path)
    with system.open_input_stream(file) as raw:
        rest = b""
        while chunk := raw.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from (json.loads(x) for x in whole if x.strip())
        if rest.strip():
            yield json.loads(rest)


@dataclass
class HubFile(InputPartition):
    hub: str
    file: str


class HubReader(DataSourceReader):
    """Rows of the hubs rendered below a folder, hub=<name>/<files of JSON lines>."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.held_back = {h for h in options.get("held_back", "").split(",") if h}
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and f.attribute in (("hub",), ("artifact_id",)) else None
            if column is None:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[HubFile]:
        hubs = [(folder.removeprefix("hub="), file) for folder, file in _files(self.path)]
        return [HubFile(hub, file) for hub, file in hubs if hub not in self.held_back and hub in self.wanted.get("hub", {hub})]

    def read(self, partition: HubFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        only, rows = self.wanted.get("artifact_id"), []
        for x in _lines(self.path, partition.file):
            if only is not None and x["artifact_id"] not in only:
                continue
            metadata = x.get("metadata") or {}
            number = str(metadata.get("revision") or "")
            rows.append((partition.hub, x["artifact_id"], int(number) if re.fullmatch(r"-?[0-9]+", number) else 0, x.get("acl"), metadata.get("principal"), x.get("location"), x.get("text"), x.get("title")))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string())
    names = [f.strip().split(" ")[0] for f in ROW.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class HubSource(DataSource):
    """Options: path, and held_back (hubs left out, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> HubReader:
        return HubReader(dict(self.options))


@dataclass
class LogPart(InputPartition):
    file: str
    after: int
    upto: int


class ChangeReader(DataSourceStreamReader):
    """Changes after an offset, which is a change's number: parts of the log say in their names which numbers they hold, so offsets need no file opened."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start = int(options.get("after", "0"))

    def _parts(self) -> list[tuple[int, int, str]]:
        named = ((re.fullmatch(r"([0-9]+)-([0-9]+)", folder), file) for folder, file in _files(self.path))
        return [(int(m[1]), int(m[2]), file) for m, file in named if m]

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        return {"seq": max([self.start, *(last for _, last, _ in self._parts())])}

    def partitions(self, start: dict, end: dict) -> list[LogPart]:
        return [LogPart(file, start["seq"], end["seq"]) for first, last, file in self._parts() if last > start["seq"] and first <= end["seq"]]

    def read(self, partition: LogPart) -> Iterator[tuple]:
        for x in _lines(self.path, partition.file):
            if partition.after < x["seq"] <= partition.upto:
                yield x["seq"], x.get("hub"), x.get("kind"), x.get("subject")

    def commit(self, end: dict) -> None:
        """The log keeps everything: cursors are the stream's own."""


class ChangeSource(DataSource):
    """Options: path, and after (the number that a new stream begins behind)."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HubSource)
    spark.dataSource.register(ChangeSource)


def hubs(spark: SparkSession, path: str, held_back: tuple[str, ...] = ()) -> DataFrame:
    register(spark)
    return spark.read.format("hub").option("held_back", ",".join(held_back)).load(path)


def append_log(log: str, rows: DataFrame, first: int, last: int) -> None:
    """Add numbered changes (seq, hub, kind, subject) from first to last as one part of a log."""
    write_json_lines(rows.where(F.col("seq").between(first, last)).select("seq", "hub", "kind", "subject"), f"{log}/{first:015d}-{last:015d}")


def _rendered(spark: SparkSession, sf_dir: str) -> str:
    """documents as hubs by source; one in three has a revision, one in four an owner."""
    d = F.col("doc_id")
    metadata = F.struct(F.when(d % 3 == 0, (d % 5).cast("string")).when(d % 3 == 1, "draft").alias("revision"), F.when(d % 4 == 0, F.concat(F.lit("user"), (d % 10).cast("string"))).alias("principal"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("hub"), F.concat(F.lit("doc-"), d.cast("string")).alias("artifact_id"), F.array("lang").alias("acl"), "text", metadata.alias("metadata"), F.col("lang").alias("location"), F.lit(None).cast("string").alias("title"))
    folder = shared_folder(spark)
    render(rows, folder)
    return folder


_HUB = "SELECT source AS hub, 'doc-' || doc_id AS artifact_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS INT) ELSE 0 END AS revision, lang AS acl, CASE WHEN doc_id % 4 = 0 THEN 'user' || doc_id % 10 END AS owner, lang AS location, sha256(text) AS text_hash FROM documents"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("hub", "artifact_id", "revision", F.array_join("acl", ",").alias("acl"), "owner", "location", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query(f"{_HUB} WHERE source NOT IN ('src7', 'src9')")
def hub_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All released hubs, read by the hub source from what was rendered."""
    return _shown(hubs(spark, _rendered(spark, sf_dir), ("src7", "src9")))


@query(f"{_HUB} WHERE source IN ('src1', 'src3') AND lang = 'en'")
def hub_scan_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hubs' artifacts: their files alone are read."""
    rows = hubs(spark, _rendered(spark, sf_dir))
    return _shown(rows.where(F.col("hub").isin("src1", "src3") & (F.col("location") == "en")))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, 'hub' || user_id % 3 AS hub, event_type AS kind, CAST(user_id AS VARCHAR) AS subject FROM events")
def stream_change_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log read by its own streaming source; the log grows between two runs of the stream."""
    from evigrid.streaming.feed import drained

    register(spark)
    folder = shared_folder(spark)
    rows = numbered(table(spark, sf_dir, "events")).select(F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("hub"), (F.col("user_id") % 3).cast("string")).alias("hub"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"))
    n = rows.count()
    for first, last in ((1, n // 2), (n // 2 + 1, n)):
        append_log(f"{folder}/log", rows, first, last)
        stream = spark.readStream.format("changes").load(f"{folder}/log")
        drained(stream, folder, lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/read/batch={i}"))
    return spark.read.parquet(f"{folder}/read").drop("batch")
