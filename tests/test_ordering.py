"""Running sums, earlier values and packing against plain loops, with one hot group over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators.assembly import greedy_pack
from evigrid.operators.ordering import last_before, running


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else rng.choice("abc"), i, None if rng.random() < 0.3 else rng.randrange(40)) for i in rng.sample(range(10_000), 3000)]


@pytest.fixture
def rows(spark, data):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(data, "g string, i long, v long").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(rows, data):
    found = {r["i"]: r["s"] for r in running(rows, ["g"], ["i"], F.col("v"), "s").collect()}
    sums = {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        assert found.pop(i) == sums[g]
    assert not found


def test_running_over_all(rows, data):
    found = sorted((r["i"], r["n"]) for r in running(rows, [], ["i"], F.lit(1), "n").collect())
    assert found == [(i, n + 1) for n, i in enumerate(sorted(i for _, i, _ in data))]


def test_last_before(rows, data):
    found = {r["i"]: r["b"] for r in last_before(rows, ["g"], ["i"], F.col("v"), "b").collect()}
    last = {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        assert found[i] == last.get(g)
        if v is not None:
            last[g] = v


@pytest.mark.parametrize("step", [1000, 7])
def test_greedy_pack(rows, data, step):
    found = {(r["g"], r["i"]) for r in greedy_pack(rows, "g", "i", "v", 150, step).collect()}
    want, used = set(), {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        if v is not None and used.get(g, 0) + v <= 150:
            used[g] = used.get(g, 0) + v
            want.add((g, i))
    assert found == want


def test_empty(spark):
    none = spark.createDataFrame([], "g string, i long, v long")
    assert running(none, ["g"], ["i"], F.col("v"), "s").count() == last_before(none, [], ["i"], F.col("v"), "b").count() == greedy_pack(none, "g", "i", "v", 9).count() == 0
