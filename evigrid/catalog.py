"""All queries of the engine and their SQL."""

from __future__ import annotations

from evigrid.operators import assembly, conflicts, intervals, json_walk, merges, resolution, traversal, witnesses, leaks, ledger, search_index, evaluation, excerpts, exchange, planted, reservation, calibration, changes, decisions, generation, generators, identity, integrity, mutations, planning, provider, reports, requests, scoring, search, statistics, versions
from evigrid.plans import registry
from evigrid.sources import files, hubs, round_trips, runs
from evigrid.streaming import deadlines, feed

MODULES = (search, search_index, leaks, ledger, conflicts, json_walk, intervals, merges, resolution, traversal, witnesses, identity, versions, assembly, evaluation, reservation, planning, decisions, provider, requests, excerpts, exchange, planted, reports, scoring, statistics, calibration, integrity, changes, mutations, feed, deadlines, generators, generation, files, runs, hubs, round_trips)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
