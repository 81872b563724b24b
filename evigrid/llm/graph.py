"""Connected components of an edge table: rounds of DataFrame operations, after a contraction inside each partition if wanted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import checkpointed, thrifty

#: Edges that are contracted in one task: 16 bytes each.
EDGES = 1 << 19


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One step of the two that alternate: each node's neighbours (large: the greater ones) move to the least of them.

    The least neighbour comes from an aggregate, whose rows are summed before they are dealt out, and
    goes back to the edges by a plain equi-join, which adaptive execution splits where a node is a hub.
    """
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    joined = both.join(least, "n")
    if large:
        out = joined.where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").coalesce(parts)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (a, b), sorted, and the least node that each one reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges of whole-number nodes, replaced inside each partition by stars around its components' least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > 2 * EDGES:
                a, b = _stars(a, b)
                if len(a) > EDGES:  # many nodes: what is contracted so far goes on
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                    a, b = a[:0], b[:0]
        a, b = _stars(a, b)
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return edges.select("a", "b").mapInArrow(thrifty(run), "a long, b long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, least = least_reachable(a, b)
    rest = nodes != least
    return nodes[rest], least[rest]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, contract: bool = False) -> DataFrame:
    """(node, component): component is the least node reachable. Nodes without an edge do not appear.

    Large-star and small-star alternate (Kiveris et al., 2014) until the edges are stars around each
    component's least node: O(log**2 n) rounds. Each round is cut by a checkpoint in the shared folder.
    Edges with a null end are ignored, as are loops and repeated edges.

    contract: nodes are BIGINT and every partition first replaces its edges by stars, in Arrow; what then fits one task
    (EDGES) is settled by one more contraction, without rounds.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = pairs.where("x IS NOT NULL AND y IS NOT NULL AND a <> b").select("a", "b")
    now = checkpointed(_contracted(pairs) if contract else pairs.distinct())
    seen = _digest(now)
    if contract and 0 < seen[0] <= EDGES:
        now, seen = checkpointed(_contracted(now.coalesce(1))), (0,)
    for _ in range(most_rounds if seen[0] else 0):
        parts = max(8, seen[0] // 50_000)  # tasks by the number of edges: else every round leaves many tiny files
        now = checkpointed(_star(_star(now.coalesce(parts), True, parts), False, parts).distinct().coalesce(parts))
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """The edges' number and an order-free digest: two rounds with the same are taken as equal."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(7)))).first()
    return tuple(row)
