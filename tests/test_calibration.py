"""Calibrators against plain versions, and their edge cases."""

import math

import numpy as np
import pytest

from evigrid.operators import calibration as C

RECORD = "grp string, p_raw double, label int"


def some(n=240, seed=5):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.02, 0.98, n).round(6)
    return [(f"g{i % 23}", float(x), int(rng.random() < x**2)) for i, x in enumerate(p)]


def plain(rows, name):
    x, y = np.array([math.log(p / (1 - p)) for _, p, _ in rows]), np.array([t for *_, t in rows])
    l2a, l2b = C.CALIBRATORS[name]
    a, b = (1.0 if l2a is None else 0.0), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        if l2a is None:
            b -= (np.sum(p - y) + l2b * b) / (w.sum() + l2b)
            continue
        step = np.linalg.solve([[(w * x * x).sum() + l2a, (w * x).sum()], [(w * x).sum(), w.sum() + l2b]], [((p - y) * x).sum() + l2a * a, (p - y).sum() + l2b * b])
        a, b = a - step[0], b - step[1]
    return a, b


def test_nested_cv(spark):
    rows = some()
    df = spark.createDataFrame(rows, RECORD)
    fold = {r["grp"]: r["fold"] for r in C.folds(df).collect()}
    got = {r["fold"]: r for r in C.nested_cv(df).collect()}
    assert set(got) == set(range(5))
    for k, r in got.items():
        held, train = [x for x in rows if fold[x[0]] == k], [x for x in rows if fold[x[0]] != k]
        a, b = plain(train, r["calibrator"])
        p = [1 / (1 + math.exp(-(a * math.log(x / (1 - x)) + b))) for _, x, _ in held]
        y = [t for *_, t in held]
        assert (r["n"], r["positives"], r["groups"]) == (len(held), sum(y), len({g for g, *_ in held}))
        assert r["brier"] == pytest.approx(np.mean([(u - v) ** 2 for u, v in zip(p, y)]), abs=2e-6)
        assert r["log_loss"] == pytest.approx(-np.mean([math.log(u if v else 1 - u) for u, v in zip(p, y)]), abs=2e-6)
        wins = [1.0 if u > w else 0.5 if u == w else 0.0 for u, v in zip(p, y) if v for w, z in zip(p, y) if not z]
        assert r["auc"] == pytest.approx(np.mean(wins), abs=2e-6)


def test_source_intercepts_settle_where_the_gradient_is_zero(spark):
    rows = some(120)
    a, b, own = C.source_intercepts(spark.createDataFrame(rows, RECORD))
    gap = [(g, math.log(p / (1 - p)), 1 / (1 + math.exp(-(a * math.log(p / (1 - p)) + b + own[g]))) - y) for g, p, y in rows]
    assert sum(d * x for _, x, d in gap) + 1e-4 * a == pytest.approx(0, abs=1e-6)
    for s in own:
        assert sum(d for g, _, d in gap if g == s) + own[s] == pytest.approx(0, abs=1e-6)


def test_without_records_or_with_one_class(spark):
    none = spark.createDataFrame([], RECORD)
    assert C.nested_cv(none).collect() == [] == C.isotonic(none).collect() and C.source_intercepts(none) == (0.0, 0.0, {})
    one = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 1), ("b", None, 1)], RECORD)
    assert C.nested_cv(one).collect() == []
    assert [(r["n"], r["fitted"]) for r in C.isotonic(one).collect()] == [(2, 1.0)]
