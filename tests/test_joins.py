"""Interval joins, merges and traversal against plain versions."""

import numpy as np
import pytest

from evigrid.operators import intervals, merges, traversal

SPAN = "key long, {0} long, start long, end long"


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_overlap_join(spark, size):
    rng = np.random.default_rng(size)

    def some(n):
        starts = rng.integers(0, 200, n)
        return [(int(rng.integers(0, 3)), i, int(s), int(s + rng.integers(0, 30))) for i, s in enumerate(starts)]

    a, b = some(80), [*some(60), (0, 99, 0, 10_000)]
    got = intervals.overlap_join(spark.createDataFrame(a, SPAN.format("left")), spark.createDataFrame(b, SPAN.format("right")), ["key"], size)
    want = sorted((k, i, j) for k, i, s, e in a for q, j, t, f in b if k == q and s < f and t < e)
    assert sorted((r["key"], r["left"], r["right"]) for r in got.collect()) == want and len(want) > 50


def test_units(spark):
    docs = [(1, "x" * 401), (2, "é" * 200), (3, ""), (4, None)]
    got = intervals.units_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 200), (1, 1, 200, 400), (1, 2, 400, 401), (2, 0, 0, 200)]


def test_units_of_documents_with_spans_only(spark, monkeypatch):
    """What meets the spans grows with the documents that have some, not with all letters."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text").union(spark.createDataFrame([(500, "x" * 401), (501, None)], "doc_id long, text string"))
    spans = spark.createDataFrame([(7, 500, 190, 210), (8, 500, 400, 401), (9, 3, 600, 800)], "item_id long, doc_id long, start long, end long")
    sides, join = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, *more: sides.append(b) or join(a, b, *more))
    monkeypatch.setattr(intervals, "item_spans", lambda *_: spans)
    monkeypatch.setattr(intervals, "table", lambda *_: docs)
    got = intervals.span_units(spark, "")
    assert sorted(map(tuple, got.collect())) == [(7, 500, 190, 0, False), (7, 500, 190, 1, False), (8, 500, 400, 2, True), (9, 3, 600, 3, True)]
    assert sides[0].count() == 3 + 11


def plain_merge(plans, outcome, authoritative, fetch_gap):
    current = None
    for _, call, status, reasons, required in sorted(plans, key=lambda p: p[0]):
        if current is None:
            current = [call, status, set(reasons), required]
            continue
        current[3] |= required
        if call and not current[0]:
            current[:3] = call, status, set(reasons)
        elif call == current[0]:
            current[2] |= set(reasons)
    call, status, reasons, required = current
    if call:
        status = {"ok": "called", "timeout": "timeout"}.get(outcome or "timeout", "error")
    gap = None
    if call and authoritative and (status in ("timeout", "error") or fetch_gap):
        gap = merges.UNAVAILABLE
    elif required and merges.DENIED in reasons:
        gap = merges.DENIED
    elif required and (status in ("timeout", "error", "unsupported_for_mode") or fetch_gap):
        gap = merges.UNAVAILABLE
    return status, sorted(reasons | ({gap} if gap == merges.UNAVAILABLE else set())), gap


def test_merged_outcomes(spark):
    """The aggregate gives what going through the plans in order gives; sources without plans of a kind, without observations, without reasons."""
    rng = np.random.default_rng(9)
    plans, seen = [], []
    for request in range(120):
        for i in range(rng.integers(1, 5)):
            call = bool(rng.integers(0, 2))
            plans.append((request, "s", i, call, "called" if call else ["skipped", "unsupported_for_mode"][rng.integers(0, 2)], [["a"], ["b", "a"], [merges.DENIED], []][rng.integers(0, 4)], bool(rng.integers(0, 2))))
        if request % 4:
            seen.append((request, "s", [None, "ok", "ok", "timeout", "error"][rng.integers(0, 5)], bool(rng.integers(0, 2)), bool(rng.integers(0, 2))))
    got = merges.merged_outcomes(
        spark.createDataFrame(plans, "request long, source string, ord long, call boolean, status string, reasons array<string>, required boolean"),
        spark.createDataFrame(seen, "request long, source string, outcome string, authoritative boolean, fetch_gap boolean"),
    )
    known = {r[0]: r[2:] for r in seen}
    want = {q: plain_merge([p[2:] for p in plans if p[0] == q], *known.get(q, (None, False, False))) for q in range(120)}
    assert {r["request"]: (r["status"], r["reasons"], r["gap"]) for r in got.collect()} == want
    assert {w[2] for w in want.values()} == {None, merges.UNAVAILABLE, merges.DENIED}


def test_found_by(spark):
    rng = np.random.default_rng(3)
    hits = [(int(q), "ab"[s], i, int(rng.integers(0, 9)), "v", None if i % 5 == 0 else int(rng.integers(0, 3))) for q in range(4) for s in range(2) for i in range(25)]
    want = []
    for q in range(4):
        seen, budget = {}, 7
        for _, s, _, a, v, x in sorted((h for h in hits if h[0] == q), key=lambda h: h[1:3]):
            if (s, a, v) in seen:
                seen[s, a, v] |= {x} - {None}
            elif budget > 0:
                seen[s, a, v], budget = {x} - {None}, budget - 1
        want += [(q, n, *key, sorted(found)) for n, (key, found) in enumerate(seen.items(), 1)]
    got = merges.found_by(spark.createDataFrame(hits, "request long, source string, pos long, artifact long, version string, interpretation long"), 7)
    assert sorted((r["request"], r["place"], r["source"], r["artifact"], r["version"], r["interpretations"]) for r in got.collect()) == sorted(want)


def test_reachable(spark):
    """Cycles, several ways, invisible hops, a hidden start, a start without edges, repeated rows."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "x"), ("x", "d"), ("d", "e"), ("a", "b"), ("h", "a")]
    starts = [(r, s) for r in ("p", "q") for s in ("a", "h", "z")]
    hidden = [("q", "c"), ("p", "h")]
    got = traversal.reachable(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(starts, "reader string, start string"), spark.createDataFrame(hidden, "reader string, node string"))
    rows = {(r["reader"], r["start"], r["node"], r["hops"]) for r in got.collect()}
    assert rows == {
        *(("p", "a", n, h) for n, h in (("b", 1), ("c", 2), ("x", 2), ("d", 3), ("e", 4))),
        *(("q", "a", n, h) for n, h in (("b", 1), ("x", 2), ("d", 3), ("e", 4))),
        *(("q", "h", n, h) for n, h in (("a", 1), ("b", 2), ("x", 3), ("d", 4), ("e", 5))),
    }


def test_witnessed(spark):
    """Either orientation, all spans of a witness in one unit, the first of several relations, another version, a unit that was not returned."""
    from evigrid.operators import witnesses

    place = "source string, artifact long, version string, start int, end int"
    units = [("r", 1, "s", 10, "v1", 0, 100), ("r", 2, "s", 20, "v1", 0, 100), ("r", 3, "s", 20, "v2", 0, 100), ("r", 4, "s", 10, "v1", 50, 200), ("q", 1, "s", 10, "v1", 0, 100)]
    spans = [
        ("r", 0, "version", "a", "s", 10, "v1", 10, 20), ("r", 0, "version", "a", "s", 10, "v1", 60, 90), ("r", 0, "version", "b", "s", 20, "v1", 0, 100),
        ("r", 1, "contradiction", "a", "s", 20, "v1", 5, 6), ("r", 1, "contradiction", "b", "s", 10, "v1", 60, 61),
    ]
    flagged = [("r", 1, 2, "version"), ("r", 2, 1, "contradiction"), ("r", 4, 2, "contradiction"), ("r", 1, 3, "version"), ("r", 1, 9, "version"), ("q", 1, 1, "version")]
    got = witnesses.witnessed(spark.createDataFrame(flagged, "request string, a long, b long, relation string"), spark.createDataFrame(units, f"request string, unit long, {place}"), spark.createDataFrame(spans, f"request string, ord int, expected string, side string, {place}")).cache()
    assert {(r["a"], r["b"]): r["matched"] for r in got.where("request = 'r'").collect()} == {(1, 2): 0, (2, 1): 0, (4, 2): 1, (1, 3): None, (1, 9): None}
    scores = witnesses.conflict_scores(got, spark.createDataFrame(spans, f"request string, ord int, expected string, side string, {place}"))
    assert sorted(map(tuple, scores.collect())) == [("q", 1, 1, 1, None), ("r", 5, 0, 2, round(2 / 3, 6))]
