"""The ledger against a plain fold, with few and many undecided calls, and each ceiling cutting first."""

import numpy as np
import pytest

from evigrid.operators.ledger import ledger

CALLS = "call_id long, at long, estimate long, input_tokens long, output_tokens long"


def plain(rows, max_calls, max_input, max_output):
    calls = spent = output = 0
    out = {}
    for call, _, estimate, reported, said in sorted(rows, key=lambda r: r[1]):
        why = "calls" if calls + 1 > max_calls else "input" if spent + estimate > max_input else "output" if max_output is not None and output >= max_output else None
        settles = estimate if reported is None else reported
        out[call] = (why, 0 if why else settles)
        if why is None:
            calls, spent, output = calls + 1, spent + settles, output + (said or 0)
    return out


@pytest.mark.parametrize(("limits", "fold"), [((10**6, 3000, None), 20), ((10**6, 3000, None), 10**6), ((60, 3000, None), 20), ((10**6, 3000, 900), 20), ((10**6, 10**9, None), 20), ((10**6, 0, 5), 20)])
def test_ledger(spark, limits, fold):
    rng = np.random.default_rng(sum(limits[:2]) % 97)
    rows = [(i, (i * 7919) % 1009, int(e), None if i % 3 == 0 else int(e * rng.random() * 1.4), None if i % 11 == 0 else int(rng.integers(0, 20))) for i, e in enumerate(rng.integers(0, 120, 300))]
    got = ledger(spark.createDataFrame(rows, CALLS), ["at"], *limits, fold=fold).collect()
    assert {r["call_id"]: (r["refused_by"], r["spent"]) for r in got} == plain(rows, *limits)
    assert fold > 10**5 or limits[1] != 3000 or {r["refused_by"] for r in got} >= {None, "input" if limits[0] > 100 else "calls"}


def test_no_calls(spark):
    assert ledger(spark.createDataFrame([], CALLS), ["at"], 5, 5).count() == 0
