"""Streams over several micro-batches, taken up again, with late data."""

import datetime as dt

from evigrid.streaming import feed

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def event(i, hour, user=1, kind="view"):
    return (i, dt.datetime(2024, 1, 1, hour, i % 60), user, kind)


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def test_views_are_numbered_across_batches_and_restarts(spark, tmp_path):
    put(spark, tmp_path / "in", [event(1, 1), event(2, 1, 2), event(3, 2, 1, "error")])
    put(spark, tmp_path / "in", [event(4, 3), event(5, 3, 3)])
    work = str(tmp_path / "work")
    first = feed.deliver_views(feed.file_stream(spark, str(tmp_path / "in"), 1), work).collect()
    assert sorted((r["reader"], r["reader_seq"]) for r in first) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    put(spark, tmp_path / "in", [event(6, 4), event(7, 4, 3), event(8, 4)])
    rows = feed.deliver_views(feed.file_stream(spark, str(tmp_path / "in"), 1), work).collect()
    assert {(r["reader"], r["reader_seq"]): r["event_id"] for r in rows if r["event_id"] > 5} == {(1, 3): 6, (1, 4): 8, (3, 2): 7}
    assert {r["event_id"] for r in rows} == {1, 2, 4, 5, 6, 7, 8}


def test_late_events_are_dropped(spark, tmp_path):
    work, source = str(tmp_path / "work"), str(tmp_path / "in")
    for rows in ([event(1, 1)], [event(2, 9)], [event(3, 1), event(4, 8)]):  # the third file's first event comes after the watermark
        put(spark, source, rows)
        got = feed.deliver_latest(feed.hourly(feed.file_stream(spark, source)), work, ["hour", "kind"]).collect()
    assert {r["hour"].hour: r["n"] for r in got} == {1: 1, 9: 1, 8: 1}


def test_refused_events_are_kept_aside(spark, tmp_path):
    put(spark, tmp_path / "in", [event(1, 1), event(2, 1, 2)])
    shown, refused = feed.deliver_permitted(feed.file_stream(spark, str(tmp_path / "in")), spark.createDataFrame([(2,)], "user_id bigint"), str(tmp_path / "work"))
    assert [r["event_id"] for r in shown.collect()] == [1] and [r["event_id"] for r in refused.collect()] == [2]


CALL = "call_id bigint, request_id bigint, ts timestamp_ntz, opens boolean"


def test_call_deadlines(spark, tmp_path):
    """A timer closes a silent request's call once; a late answer is unmatched; a second call is refused while one is open; state holds open calls only."""
    from evigrid.streaming import deadlines

    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    slices = [
        [(1, 1, at(0), True), (2, 1, at(2), False), (3, 2, at(3), True), (4, 2, at(4), True), (5, 3, at(5), True)],
        [(6, 2, at(9), False), (7, 3, at(20), False), (8, 4, at(21), True), (9, 1, at(22), True)],
        [(10, 9, at(60), True), (11, 4, at(61), False)],
        [(12, 10, at(100), False)],
    ]
    seen = []
    for rows in slices:
        spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = deadlines.call_verdicts(feed.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "work"), 10 * 60_000, "1 minute")
        seen.append(sorted((r["call_id"], r["request_id"], r["verdict"]) for r in got.collect()))
    assert seen[0] == [(1, 1, "answered"), (4, 2, "refused")]
    assert seen[1] == sorted([*seen[0], (3, 2, "answered"), (5, 3, "timeout"), (7, 3, "unmatched")])
    assert seen[2] == sorted([*seen[1], (8, 4, "timeout"), (9, 1, "timeout"), (11, 4, "unmatched")])
    assert seen[3] == sorted([*seen[2], (10, 9, "timeout"), (12, 10, "unmatched")])
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "work" / "progress"))
    assert state.count() == 0  # all calls are closed


class Messages:
    """A value state and its timers that count how often they are used, as each use is a message to the JVM."""

    def __init__(self):
        self.value, self.timers, self.n = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _used(self):
        self.n += 1

    def exists(self):
        self._used()
        return self.value is not None

    def get(self):
        self._used()
        return self.value

    def update(self, value):
        self._used()
        self.value = value

    def clear(self):
        self._used()
        self.value = None

    def registerTimer(self, at):
        self._used()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._used()
        self.timers.remove(at)


def test_call_state_is_used_once_a_batch():
    """Many events of one request in a batch: state and timers are read and written once, and hold what is open at the end."""
    from pyspark.sql import Row

    from evigrid.streaming import deadlines

    event, state = Row("request_id", "call_id", "ts", "at_ms", "opens"), Messages()
    processor = deadlines.Deadlines(10)
    processor.init(state)

    def batch(rows):
        state.n = 0
        return [tuple(r) for r in processor.handleInputRows((7,), iter([event(7, c, None, at, opens) for c, at, opens in rows]), None)]

    pairs = [(c, 2 * c, c % 2 == 0) for c in range(40)]
    assert batch([*pairs[::-1], (50, 100, True), (51, 105, True)]) == [(c, 7, "answered") for c in range(0, 40, 2)] + [(51, 7, "refused")]
    assert state.n <= 3 and (state.value, state.timers) == ((50, 110), {110})
    assert batch([(52, 110, True)]) == [(52, 7, "refused")] and state.n == 1
    assert batch([(53, 111, True), (54, 112, False), (55, 113, True)]) == [(50, 7, "timeout"), (53, 7, "answered")]
    assert state.n <= 4 and (state.value, state.timers) == ((55, 123), {123})
    assert batch([(56, 114, False), (57, 115, False)]) == [(55, 7, "answered"), (57, 7, "unmatched")]
    assert state.n <= 3 and (state.value, state.timers) == (None, set())
