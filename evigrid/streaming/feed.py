"""The change feed as streams: reader views, cursors, windows with late data, revocation.

Every stream reads files, writes one folder a micro-batch and can be stopped and taken up again: a batch that is repeated after a
failure overwrites its own folder, so each event counts once. Folders lie under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.changes import _VIEW
from evigrid.operators.ordering import last_before, running
from evigrid.plans.registry import query
from evigrid.sources.scratch import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or a single file (which a file source takes only as a pattern)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, folder: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything there is now, in micro-batches, then stop; called again, it takes up what came since."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def deliver_views(stream: DataFrame, folder: str) -> DataFrame:
    """(reader, reader_seq, event_id, kind): each reader's events, densely numbered across batches.

    A reader's last number is kept as a table of its own for each batch; numbers inside a batch are running sums over ranges.
    Errors are never shown. Order holds inside a batch by (ts, event_id), between batches by arrival.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        last = spark.read.parquet(f"{folder}/readers/batch={i - 1}") if i else spark.createDataFrame([], "reader bigint, delivered bigint")
        shown = df.where("event_type <> 'error'").select(F.col("user_id").alias("reader"), "ts", "event_id", F.col("event_type").alias("kind"))
        rows = running(shown, ["reader"], ["ts", "event_id"], F.lit(1), "own").join(last, "reader", "left").select("reader", (F.col("own") + F.coalesce("delivered", F.lit(0))).cast("bigint").alias("reader_seq"), "event_id", "kind")
        rows.write.mode("overwrite").parquet(f"{folder}/views/batch={i}")
        now = spark.read.parquet(f"{folder}/views/batch={i}").groupBy("reader").agg(F.max("reader_seq").alias("now"))
        kept = last.join(now, "reader", "full").select("reader", F.coalesce("now", "delivered").alias("delivered"))
        kept.write.mode("overwrite").parquet(f"{folder}/readers/batch={i}")

    drained(stream, folder, batch)
    return stream.sparkSession.read.parquet(f"{folder}/views").drop("batch")


def deliver_latest(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The last value of each key of an aggregate in update mode."""

    def batch(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/updates/batch={i}")

    drained(stream, folder, batch, "update")
    rows = stream.sparkSession.read.parquet(f"{folder}/updates")
    values = F.struct(*(c for c in rows.columns if c not in (*keys, "batch")))
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*")


def hourly(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counts by hour and kind; events later than the delay behind the newest one seen are dropped, and their hours' state with them."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("hour"), "kind", "n")


def deliver_permitted(stream: DataFrame, revoked: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events of readers that are not revoked, and those refused: the anomaly stream, as a second sink of the same batch."""

    def batch(df: DataFrame, i: int) -> None:
        marked = df.join(revoked.select("user_id", F.lit(True).alias("gone")), "user_id", "left").withColumn("side", F.when(F.col("gone"), "refused").otherwise("shown")).drop("gone")
        marked.write.mode("overwrite").partitionBy("side").parquet(f"{folder}/events/batch={i}")

    drained(stream, folder, batch)
    rows = stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, side string, batch int").parquet(f"{folder}/events").drop("batch")
    return rows.where("side = 'shown'").drop("side"), rows.where("side = 'refused'").drop("side")


def deliver_anomalies(stream: DataFrame, folder: str) -> DataFrame:
    """(event_id, anomaly): what should not happen in a request (user_id) at that moment.

    A click opens a call, a purchase closes it. A signup inside a call is a token issued during it, a view outside of one uses a
    binding that is not active, a click inside one is a second binding, an error is a mismatch. Whether a request is inside a call
    is kept as a table of its own for each batch; inside a batch the last opening or closing before an event counts.
    """
    opens = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "purchase", False)

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        before = spark.read.parquet(f"{folder}/requests/batch={i - 1}") if i else spark.createDataFrame([], "user_id bigint, open boolean")
        rows = last_before(df.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], opens, "was").join(before, "user_id", "left")
        inside = F.coalesce("was", "open", F.lit(False))
        kind = F.col("event_type")
        anomaly = F.when(kind == "error", "mismatch").when((kind == "signup") & inside, "issued_during_call").when((kind == "view") & ~inside, "inactive_binding").when((kind == "click") & inside, "second_binding")
        rows.select("event_id", anomaly.alias("anomaly")).where("anomaly IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/anomalies/batch={i}")
        now = df.where(opens.isNotNull()).groupBy("user_id").agg(F.max_by(opens, F.struct("ts", "event_id")).alias("now"))
        before.join(now, "user_id", "full").select("user_id", F.coalesce("now", "open").alias("open")).write.mode("overwrite").parquet(f"{folder}/requests/batch={i}")

    drained(stream, folder, batch)
    return stream.sparkSession.read.schema("event_id bigint, anomaly string, batch int").parquet(f"{folder}/anomalies").drop("batch")


@query("""WITH s AS (SELECT *, coalesce(last_value(CASE event_type WHEN 'click' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM events),
a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'mismatch' WHEN event_type = 'signup' AND inside THEN 'issued_during_call' WHEN event_type = 'view' AND NOT inside THEN 'inactive_binding' WHEN event_type = 'click' AND inside THEN 'second_binding' END AS anomaly FROM s) SELECT * FROM a WHERE anomaly IS NOT NULL""")
def stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver_anomalies(file_stream(spark, f"{sf_dir}/events.parquet"), shared_folder(spark))


@query("SELECT user_id AS reader, CAST(props->>'$.k' AS BIGINT) AS subject, max(event_id) AS at_event FROM events WHERE event_type <> 'view' GROUP BY ALL")
def stream_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader must read anew, with the change that said so last: a row for each reader and subject, so no reader's set is one value."""
    changed = file_stream(spark, f"{sf_dir}/events.parquet").where("event_type <> 'view'")
    state = changed.groupBy(F.col("user_id").alias("reader"), F.get_json_object("props", "$.k").cast("bigint").alias("subject")).agg(F.max("event_id").alias("at_event"))
    return deliver_latest(state, shared_folder(spark), ["reader", "subject"])


@query(f"WITH {_VIEW} SELECT * FROM v")
def stream_reader_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliver_views(file_stream(spark, f"{sf_dir}/events.parquet"), shared_folder(spark))


@query("SELECT user_id AS reader, max(event_id) AS cursor_, count(*) AS n FROM events GROUP BY user_id")
def stream_reader_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's state: how far it has been served."""
    state = file_stream(spark, f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("reader")).agg(F.max("event_id").alias("cursor_"), F.count("*").alias("n"))
    return deliver_latest(state, shared_folder(spark), ["reader"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deliver_latest(hourly(file_stream(spark, f"{sf_dir}/events.parquet")), shared_folder(spark), ["hour", "kind"])
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 15)")
def stream_revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    revoked = spark.read.parquet(path).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 15").select("user_id")
    return deliver_permitted(file_stream(spark, path), revoked, shared_folder(spark))[0].select("event_id")
