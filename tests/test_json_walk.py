"""Nested JSON against a plain recursion: any depth, repeated keys' places, empty containers, nulls, other kinds of bodies."""

import json

import pytest
from pyspark.sql import functions as F

from evigrid.operators import json_walk

BODIES = [
    {"artifact_id": "a", "b": [{"artifact_id": "c"}, [[{"artifact_id": "d", "n": 1.23456}]], 7, None, True, "x"], "e": {}},
    {"z": {"y": {"x": {"w": {"v": [0, [1, [2, [3, {"artifact_id": "deep"}]]]]}}}}, "artifact_id": 5, "A": False},
    {"artifact_id": {"artifact_id": "inner"}, "list": [[], {}, [[]]], "é": "ü\nline", "": ""},
    [1, 2.5, {"k": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]}],
    "only text",
    12,
    None,
    {},
]


def ids(x):
    if isinstance(x, dict):
        return ({x["artifact_id"]} if isinstance(x.get("artifact_id"), str) else set()).union(*map(ids, x.values()))
    return set().union(*map(ids, x)) if isinstance(x, list) else set()


def lines(x):
    if isinstance(x, dict):
        return "\n".join(f"{k}\n{lines(v)}" for k, v in sorted(x.items()))
    return "\n".join(map(lines, x)) if isinstance(x, list) else "" if x is None else str(x)


def numbers(x, path="$"):
    if isinstance(x, dict):
        return [r for k, v in x.items() for r in numbers(v, f"{path}.{k}")]
    if isinstance(x, list):
        return [r for i, v in enumerate(x) for r in numbers(v, f"{path}[{i}]")]
    return [(path, round(float(x), 2))] if isinstance(x, (int, float)) and not isinstance(x, bool) else []


@pytest.fixture(scope="module")
def walked(spark):
    bodies = spark.createDataFrame([*((i, json.dumps(b)) for i, b in enumerate(BODIES)), (99, None)], "id long, body string")
    return json_walk.values(bodies.withColumn("body", F.parse_json("body"))).cache()


def test_named_values(walked):
    assert {tuple(r) for r in json_walk.named_values(walked, "artifact_id").collect()} == {(i, x) for i, b in enumerate(BODIES) for x in ids(b)}


def test_public_texts(walked):
    assert {r["id"]: r["text"] for r in json_walk.public_texts(walked).collect()} == {i: lines(b) for i, b in enumerate(BODIES)}


def test_rounded(walked):
    assert sorted(map(tuple, json_walk.rounded(walked, 2).collect())) == sorted((i, *r) for i, b in enumerate(BODIES) for r in numbers(b))


def test_no_bodies(spark):
    assert json_walk.values(spark.createDataFrame([], "id long, body string").withColumn("body", F.parse_json("body"))).count() == 0


def test_deep_bodies(spark):
    """Hundreds of levels take one pass, not a step each."""
    body = '{"artifact_id":"end","n":0.125}'
    for i in range(300):
        body = f'{{"k":[{body},{i}]}}'
    walked = json_walk.values(spark.createDataFrame([(1, body)], "id long, body string").withColumn("body", F.parse_json("body")))
    assert json_walk.named_values(walked, "artifact_id").collect() == [(1, "end")]
    assert json_walk.public_texts(walked).first()["text"] == "k\n" * 300 + "artifact_id\nend\nn\n0.125\n" + "\n".join(map(str, range(300)))
    assert sorted(r["value"] for r in json_walk.rounded(walked, 2).collect()) == sorted([0.13, *map(float, range(300))])


def test_bodies_stay_in_their_rows(spark, tmp_path):
    """Texts and numbers of bodies need no shuffle, and no job before they are asked for."""
    spark.range(10).selectExpr("id", """'{"a": [1, {"b": 2}]}' AS body""").write.parquet(str(tmp_path / "bodies"))
    bodies = spark.read.parquet(str(tmp_path / "bodies")).withColumn("body", F.parse_json("body"))
    for rows in (json_walk.public_texts(json_walk.values(bodies)), json_walk.rounded(json_walk.values(bodies), 2)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.select("id").distinct().count() == 10
