"""Open calls as keyed state with timers: a call is answered, times out once, or is refused while another one of its request is open.

State is kept for requests with an open call only, so it is bounded by what is open and not by what has happened. A timer at the deadline closes a
call whose request stays silent; a later event of the request closes it too, at its own time, so that the result does not depend on where batches end.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evigrid.plans.registry import query
from evigrid.sources.scratch import shared_folder
from evigrid.sources.tables import table
from evigrid.streaming.feed import drained, file_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_VERDICT = Row("call_id", "request_id", "verdict")
_ORDER = itemgetter(3, 1)


class Deadlines(StatefulProcessor):
    """Verdicts of a request's calls, from events (request_id, call_id, ts, at_ms, opens) in the order of (at_ms, call_id)."""

    def __init__(self, deadline_ms: int) -> None:
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "call_id long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """State is read once and, if another call is open at the end, written once: each use of it is a message to the JVM and back."""
        request, kept = key[0], self.open.get()
        call, until = kept or (None, None)
        for _, own, _, at, opens in sorted(rows, key=_ORDER):
            if until is not None and until < at:
                yield _VERDICT(call, request, "timeout")
                call, until = None, None
            if not opens:
                yield _VERDICT(own, request, "unmatched") if until is None else _VERDICT(call, request, "answered")
                call, until = None, None
            elif until is not None:
                yield _VERDICT(own, request, "refused")
            else:
                call, until = own, at + self.deadline_ms
        if (call, until) != (kept or (None, None)):
            if kept:
                self.handle.deleteTimer(kept[1])
            if until is None:
                self.open.clear()
            else:
                self.open.update((call, until))
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Spark deletes the timer itself afterwards."""
        kept = self.open.get()
        if kept and kept[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield _VERDICT(kept[0], key[0], "timeout")

    def close(self) -> None:
        pass


def call_verdicts(stream: DataFrame, folder: str, deadline_ms: int, delay: str) -> DataFrame:
    """(call_id, request_id, verdict) of a stream (call_id, request_id, ts, opens), up to what the watermark (`delay` behind the newest event) has reached.

    Called again, it takes up what came since: open calls are kept in the stream's state. Events later than the watermark are dropped.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", delay)
        keyed = timed.select("request_id", "call_id", "ts", "at_ms", "opens").groupBy("request_id")
        verdicts = keyed.transformWithState(Deadlines(deadline_ms), "call_id long, request_id long, verdict string", "Append", "EventTime")

        def batch(df: DataFrame, i: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={i}")

        drained(verdicts, folder, batch)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("call_id long, request_id long, verdict string, batch int").parquet(f"{folder}/verdicts").drop("batch")


#: Of the example: how long a call may stay open, how late an event may be, and how often the stream is stopped and taken up again.
HOURS, LATE, SLICES = 36, "1 hour", 3


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_ms(ts) AS at_ms, event_type = 'click' AS opens, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events WHERE event_type IN ('click', 'purchase')),
f AS (SELECT 0::BIGINT AS n, user_id, NULL::BIGINT AS open, NULL::BIGINT AS until, NULL::BIGINT AS expired, NULL::BIGINT AS call_id, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.n, e.user_id, CASE WHEN opens THEN coalesce(o, e.event_id) END, CASE WHEN opens THEN CASE WHEN o IS NULL THEN at_ms + {HOURS} * 3600000 ELSE f.until END END, CASE WHEN f.until < at_ms THEN f.open END,
    CASE WHEN opens THEN CASE WHEN o IS NOT NULL THEN e.event_id END ELSE coalesce(o, e.event_id) END, CASE WHEN opens THEN CASE WHEN o IS NOT NULL THEN 'refused' END WHEN o IS NULL THEN 'unmatched' ELSE 'answered' END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT CASE WHEN f.until < at_ms THEN NULL ELSE f.open END AS o)),
late AS (SELECT max(at_ms) - 3600000 AS seen FROM e)
SELECT call_id, user_id AS request_id, verdict FROM f WHERE verdict IS NOT NULL UNION ALL SELECT expired, user_id, 'timeout' FROM f WHERE expired IS NOT NULL
UNION ALL SELECT open, user_id, 'timeout' FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1), late WHERE open IS NOT NULL AND until <= seen""")
def stream_call_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls (clicks) and their answers (purchases), arriving by time in slices; the stream is stopped after each and taken up again."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("request_id"), "ts", (F.col("event_type") == "click").alias("opens"))
    first, last = rows.agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    out = None
    for i in range(SLICES):
        low, high = (first + (last - first) * k // SLICES for k in (i, i + 1))
        inside = (at >= low) & ((at <= high) if i == SLICES - 1 else (at < high))
        rows.where(inside).write.mode("append").parquet(f"{folder}/calls")
        out = call_verdicts(file_stream(spark, f"{folder}/calls"), folder, HOURS * 3_600_000, LATE)
    return out
