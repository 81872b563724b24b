"""What only larger tables showed: sums and casts at their borders, joins that were planned from a file's size."""

import os
from functools import reduce
from operator import add

import pytest
from oracle import SMALL, TABLES, same

from evigrid import catalog
from evigrid.operators import decisions, resolution


@pytest.fixture
def tables(tmp_path):
    """A folder with the small tables, of which a test replaces one."""
    for t in TABLES:
        os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")

    def replaced(name, frame):
        os.unlink(tmp_path / f"{name}.parquet")
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return replaced


def test_divergences_round_values(spark, tables):
    """49,999.7 and 50,000.2 are one value, as the SQL's cast rounds; so are halves that go to the even number."""
    rows = [(1, 7, "F", 49999.7), (2, 7, "O", 50000.2), (3, 7, "P", 99999.5), (4, 7, "O", 100000.0), (5, 7, "F", 99999.4)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").selectExpr("*", "timestamp'2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    folder = tables("orders", orders)
    same(catalog.queries()["divergences"](spark, folder), catalog.oracle_sql()["divergences"], folder)


VALUES = (61.5, 100.96, 37.54)


def test_source_outcomes_sum_in_order(spark, tables):
    """The same three doubles add up to just below a whole number, or to it; the order of calls decides, not that of the files."""
    first, last = reduce(add, VALUES), reduce(add, reversed(VALUES))
    assert int(first) != int(last)
    rows = [(i + 1, 5, v) for i, v in enumerate(VALUES)] + [(i + 11, 6, v) for i, v in enumerate(reversed(VALUES))]
    events = spark.createDataFrame(rows[::-1], "event_id long, user_id long, value double").selectExpr("*", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "'signup' AS event_type", "'{}' AS props")
    got = catalog.queries()["source_outcomes"](spark, tables("events", events.repartition(1).sortWithinPartitions("event_id", ascending=False)))
    status = ["called", "called", "timeout", "error"]
    assert {r["request"]: r["status"] for r in got.collect()} == {5: status[int(first) % 4], 6: status[int(last) % 4]}


def test_label_spans_never_broadcast_grams(spark, tmp_path):
    """A few rows of many words against many labels: it is the labels that are sent to all, if anything."""
    spark.createDataFrame([(1, ["red", "bolt", "red"])], "key long, w array<string>").write.parquet(str(tmp_path / "rows"))
    spark.range(20000).selectExpr("concat('label ', id) AS label").union(spark.createDataFrame([("red",), ("red bolt",)], "label string")).write.parquet(str(tmp_path / "labels"))
    rows, labels = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "labels"))
    spans = decisions.label_spans(rows, labels)
    assert "BuildLeft" not in spans._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, spans.collect())) == [(1, 0, 2, "red bolt"), (1, 2, 3, "red")]


def test_matched_labels_never_broadcast_runs(spark, tmp_path):
    """The same for questions: few of them, many labels."""
    spark.createDataFrame([(1, "Which red bolt or red fits?")], "question long, text string").write.parquet(str(tmp_path / "questions"))
    spark.range(20000).selectExpr("concat('label ', id) AS label").union(spark.createDataFrame([("red",), ("red bolt",)], "label string")).write.parquet(str(tmp_path / "labels"))
    spans = resolution.matched_labels(spark.read.parquet(str(tmp_path / "questions")), spark.read.parquet(str(tmp_path / "labels")))
    assert "BuildLeft" not in spans._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, spans.collect())) == [(1, 2, 2, "red bolt"), (1, 5, 1, "red")]
