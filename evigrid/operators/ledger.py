"""A spending ledger with hard ceilings: each call is accepted or refused in its turn, and only accepted calls count.

Which calls pass is a fold and no running sum: a refused call reserves nothing, so a later, smaller one may still pass, and what a call reports back
settles its reservation. The fold is bounded from both sides instead of being run over all calls in one task. What surely passed so far bounds the
spending from below, what could have passed bounds it from above; calls that both bounds decide leave the game, and the few around the ceiling
that they leave undecided are folded at last, up to FOLD of them at a time, on what was surely spent before each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators.ordering import running
from evigrid.plans.registry import query
from evigrid.sources.scratch import written
from evigrid.sources.tables import calls

#: Undecided calls that one task folds: some 40 bytes each.
FOLD = 500_000


def _folded(ceiling: int):
    """Decides rows (n, estimate, spent, base) in order; base: what surely passed before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = 0
        for batch in batches:
            passed = []
            for estimate, spent, base in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                passed.append(base + own + estimate <= ceiling)
                own += spent if passed[-1] else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(passed, pa.bool_())], ["n", "passed"])

    return run


def _within(rows: DataFrame, ceiling: int, fold: int) -> DataFrame:
    """(n, passed) of rows (n, estimate, spent), by the ceiling on what is spent alone. Estimates and spendings are not negative."""
    decided, open_ = [], written(rows.withColumn("base", F.lit(0).cast("bigint")))
    while True:
        size = open_.count()
        if size <= fold:
            last = open_.repartition(1).sortWithinPartitions("n").select("n", "estimate", "spent", "base").mapInArrow(_folded(ceiling), "n long, passed boolean")
            return written(_union([*decided, last]))
        most = running(open_, [], ["n"], F.col("spent"), "upto").withColumn("upto", F.col("upto") - F.col("spent"))
        surely = F.when(F.col("base") + F.col("upto") + F.col("estimate") <= ceiling, True).when(F.col("base") + F.col("estimate") > ceiling, False)
        marked = written(most.withColumn("passed", surely))
        decided.append(marked.where("passed IS NOT NULL").select("n", "passed"))
        gained = running(marked, [], ["n"], F.when(F.col("passed"), F.col("spent")), "gained")
        open_ = written(gained.where("passed IS NULL").select("n", "estimate", "spent", (F.col("base") + F.col("gained")).alias("base")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ledger(rows: DataFrame, order: list[str], max_calls: int, max_input: int, max_output: int | None = None, fold: int = FOLD) -> DataFrame:
    """rows (call_id, estimate, input_tokens, output_tokens, *order) with (n, refused_by, spent): which ceiling refuses each call, null if none, and what it settles at.

    A call reserves its estimate and settles before the next one: at its reported input, or at the estimate where none is reported. It is refused once
    max_calls have passed, if its estimate doesn't fit in what is left, or once max_output is reached, in this order. spent is 0 for a refused call.
    """
    settled = F.coalesce("input_tokens", "estimate")
    numbered = written(running(rows, [], order, F.lit(1), "n").withColumn("settles", settled))
    passed = _within(numbered.select(F.col("n").cast("bigint").alias("n"), "estimate", F.col("settles").alias("spent")), max_input, fold)
    both = numbered.join(passed, "n")
    # calls and output only grow by calls that passed: each of these ceilings cuts everything after a point
    one, said = F.col("passed").cast("bigint"), F.when(F.col("passed"), F.coalesce("output_tokens", F.lit(0))).otherwise(0)
    counted = running(both, [], ["n"], one, "calls").withColumn("calls", F.col("calls") - one)
    counted = running(counted, [], ["n"], said, "output").withColumn("output", F.col("output") - said)
    full = F.col("calls") >= max_calls
    done = full if max_output is None else full | (F.col("output") >= max_output)
    # nothing passes from there on, and so the state stays what it is there; before, the fold over input alone is the whole fold
    state = both.crossJoin(F.broadcast(counted.where(done).agg(F.min(F.struct("n", "calls")).alias("cut"))))  # one row
    before = F.col("cut").isNull() | (F.col("n") < F.col("cut.n"))
    at_cut = state.agg(F.sum(F.when(F.col("passed") & before, F.col("settles"))).alias("input_at_cut"))
    state = state.crossJoin(F.broadcast(at_cut))
    late = F.when(F.col("cut.calls") >= max_calls, "calls").when(F.coalesce("input_at_cut", F.lit(0)) + F.col("estimate") > max_input, "input").otherwise("output")
    refused = F.when(before, F.when(~F.col("passed"), "input")).otherwise(late)
    return state.withColumn("refused_by", refused).withColumn("spent", F.when(refused.isNull(), F.col("settles")).otherwise(F.lit(0))).drop("settles", "passed", "cut", "input_at_cut")


#: Ceilings of the example.
CALLS, INPUT, OUTPUT = 1_500, 4_000_000, 400_000


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, CAST(round(value * 100) AS BIGINT) AS e, CASE WHEN event_type <> 'view' THEN CAST(round(value * 80) AS BIGINT) END AS u, CAST(round(value * 10) AS BIGINT) AS o FROM events),
f AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS calls, 0::BIGINT AS input, 0::BIGINT AS output, NULL::VARCHAR AS refused_by, 0::BIGINT AS spent
  UNION ALL SELECT n, event_id, calls + CASE WHEN r IS NULL THEN 1 ELSE 0 END, input + CASE WHEN r IS NULL THEN s ELSE 0 END, output + CASE WHEN r IS NULL THEN o ELSE 0 END, r, CASE WHEN r IS NULL THEN s ELSE 0 END
  FROM (SELECT c.n, c.event_id, f.calls, f.input, f.output, c.o, coalesce(c.u, c.e) AS s, CASE WHEN f.calls + 1 > {CALLS} THEN 'calls' WHEN f.input + c.e > {INPUT} THEN 'input' WHEN f.output >= {OUTPUT} THEN 'output' END AS r FROM f JOIN c ON c.n = f.n + 1))
SELECT event_id AS call_id, refused_by, spent FROM f WHERE n > 0""")
def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call of a campaign, accepted or refused, and what it was settled at."""
    cents = F.round(F.col("latency") * 100).cast("bigint")
    reported = F.when(F.col("source_id") != "view", F.round(F.col("latency") * 80).cast("bigint"))
    rows = calls(spark, sf_dir).select("call_id", "ts", cents.alias("estimate"), reported.alias("input_tokens"), F.round(F.col("latency") * 10).cast("bigint").alias("output_tokens"))
    return ledger(rows, ["ts", "call_id"], CALLS, INPUT, OUTPUT).select("call_id", "refused_by", "spent")
