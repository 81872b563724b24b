"""Run folders, rendered hubs, snapshots, canned answers and exchanges."""

import pytest

from evigrid.sources import runs


def test_run(spark, tmp_path):
    scores = spark.sql("SELECT 'c' AS case_id, 0.5D AS score")
    with pytest.raises(ValueError, match="not whole"):
        runs.read_run(spark, str(tmp_path), "r", "scores", scores.schema)
    runs.write_run(str(tmp_path), "r", {"scores": scores}, {"arm": "a"})
    assert runs.read_run(spark, str(tmp_path), "r", "scores", scores.schema).collect() == scores.collect()
    assert runs.read_run(spark, str(tmp_path), "r", "failures", scores.schema).collect() == []
    with pytest.raises(ValueError, match="has been written"):
        runs.write_run(str(tmp_path), "r", {"scores": scores}, {})


def test_snapshot(spark):
    rows = spark.sql("SELECT 1 AS a")
    runs.unchanged(rows, rows.schema.json())
    with pytest.raises(ValueError, match="snapshot"):
        runs.unchanged(rows.selectExpr("CAST(a AS BIGINT) AS a"), rows.schema.json())


def test_render_replaces(spark, tmp_path):
    folder = str(tmp_path / "hubs")
    both = spark.createDataFrame([("h", 1), ("h", 2), ("k", 3)], "hub string, x int")
    assert {r["hub"]: r["rows"] for r in runs.render(both, folder).collect()} == {"h": 2, "k": 1}
    first = runs.render(both.where("hub = 'h'"), folder).collect()
    assert [(r["hub"], r["rows"]) for r in first] == [("h", 2)]
    assert runs.render(both.where("hub = 'h'").repartition(3), folder).collect() == first


def test_canned(spark):
    requests, responses = spark.sql("SELECT explode(array('a', 'b')) AS request_id"), spark.sql("SELECT 'a' AS request_id, 'ok' AS status")
    assert {r["request_id"]: r["response"] and r["response"]["status"] for r in runs.canned(requests, responses).collect()} == {"a": "ok", "b": None}


def test_exchanges_hold_no_credentials(spark, tmp_path):
    rows = spark.sql("""SELECT 'r' AS request_id, 1 AS round, '{"Authorization": "x", "answer": "y"}' AS body""")
    for _ in range(2):
        runs.store_exchanges(rows, str(tmp_path / "x"))
    assert [r["body"] for r in spark.read.parquet(str(tmp_path / "x")).collect()] == ['{"answer":"y"}'] * 2
    nested = spark.sql("""SELECT 'r' AS request_id, stack(4, 1, '{"headers": {"authorization": "Bearer S", "n": 1}, "a": [{"Token": "S"}, 2]}', 2, '{"headers": "plain"}', 3, '[1]', 4, null) AS (round, body)""")
    runs.store_exchanges(nested, str(tmp_path / "y"))
    got = {r["round"]: r["body"] for r in spark.read.parquet(str(tmp_path / "y")).collect()}
    assert got == {1: '{"headers":{"n":1},"a":[{},2]}', 2: '{"headers":"plain"}', 3: None, 4: None}


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string").orderBy("n")
    runs.write_markdown(rows, str(tmp_path / "r"))
    assert [r["text"] for r in runs.read_lines(spark, str(tmp_path / "r")).orderBy("line").collect()] == ["| n | t |", "|---|---|", "| 1 | a\\|b |", "| 2 | - |"]
    with pytest.raises(ValueError, match="1 rows at most"):
        runs.write_markdown(rows, str(tmp_path / "s"), most=1)
