"""Approximate nearest neighbours by a hash-prefix forest (Bawa, Condie and Ganesan, 2005).

Each tree gives every vector a long string of sign bits. A shard of the rows keeps, for each tree, its strings in one sorted
array; a query finds the run of rows that share its longest prefix, in all trees at once, and all trees then go up one
bit at a time, together, until enough different candidates are met. Candidates are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.llm.common import table, thrifty

TREES = 96
#: Bits of a hash string.
DEPTH = 32
#: Rows of a shard.
SHARD = 8192
#: Queries that are multiplied with a shard's vectors at a time.
PIECE = 256
#: The ascent stops at so many candidates for each neighbour wanted and so large a part of the shard's rows: what recall needs on data without structure (see the README).
CANDIDATES, SHARE = 8, 0.4


class Forest:
    """Sorted hash strings of one shard's distinct vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> None:
        self.vectors, self.depth = vectors, depth
        d = vectors.shape[1] if vectors.ndim == 2 else 0
        self.planes = np.random.default_rng([seed, d]).standard_normal((trees, depth, d + 1))
        # inner product is not a distance: one more component lifts all rows to the same length (queries have 0 there)
        squares = (vectors**2).sum(axis=1)
        lift = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))
        self.order, self.strings = [], []
        for planes in self.planes:
            s = self._strings(vectors, lift, planes)
            order = np.argsort(s, kind="stable")
            self.order.append(order.astype(np.int32))
            self.strings.append(s[order])

    def _strings(self, vectors: np.ndarray, lift: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = vectors @ planes[:, :-1].T + lift[:, None] * planes[:, -1] >= 0
        return bits @ (1 << np.arange(self.depth - 1, -1, -1, dtype=np.int64))

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, the distinct rows met when all trees have gone up as far as needed."""
        n = len(self.vectors)
        zero = np.zeros(len(queries))
        own = [self._strings(queries, zero, planes) for planes in self.planes]
        low = np.empty((self.depth + 1, len(own), len(queries)), np.int32)
        high = np.empty_like(low)
        for t, q in enumerate(own):
            for depth in range(self.depth + 1):
                rest = (1 << (self.depth - depth)) - 1
                low[depth, t] = np.searchsorted(self.strings[t], q & ~rest, "left")
                high[depth, t] = np.searchsorted(self.strings[t], q | rest, "right")
        met = (high - low).sum(axis=1)
        for i in range(len(queries)):
            depth = int(np.searchsorted(-met[:, i], -enough, "right")) - 1  # the deepest level that could suffice
            while True:
                depth = max(depth, 0)
                seen = np.zeros(n, bool)
                for t in range(len(own)):
                    seen[self.order[t][low[depth, t, i] : high[depth, t, i]]] = True
                if depth == 0 or np.count_nonzero(seen) >= enough:
                    break
                depth -= 1
            yield np.flatnonzero(seen)


def _clean(vectors: DataFrame) -> DataFrame:
    """Rows that take part: a vector, not zero, with only finite components."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(~bad & F.exists(e, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row, in double precision, and where each vector begins."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))]).astype(np.int64)


def _by_dimension(values: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, numbers of the vectors that have it, these vectors as a matrix)."""
    sizes = np.diff(begin)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, values[begin[at][:, None] + np.arange(d)]


class Shard:
    """Rows of one shard that have one dimension: ids, distinct vectors, their forest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, share: float, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.k = ids[order], k
        self.kinds, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
        inverse = inverse.ravel()
        self.by_kind = np.argsort(inverse, kind="stable")  # ids ascend inside each kind
        self.begin = np.searchsorted(inverse[self.by_kind], np.arange(len(self.kinds) + 1))
        self.forest = Forest(self.kinds, trees)
        self.enough = CANDIDATES * k + int(share * len(self.kinds))

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k nearest candidates of each query, another row's id each."""
        k = self.k
        for at in range(0, len(queries), PIECE):
            rough = queries[at : at + PIECE] @ self.kinds.T
            for j, found in enumerate(self.forest.candidates(queries[at : at + PIECE], self.enough)):
                if len(found) > k + 1:
                    near = rough[j][found]
                    least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                    found = found[near >= least - 1e-9 * (1 + abs(least))]
                scores = (self.kinds[found] * queries[at + j]).sum(axis=1)
                own = query_ids[at + j]
                pairs = [(-s, i) for x, s in zip(found, scores, strict=True) for i in self.ids[self.by_kind[self.begin[x] : self.begin[x + 1]]][: k + 1] if i != own]
                yield from ((own, i, -s) for s, i in sorted(pairs)[:k])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of vectors with the largest inner product among those found.

    Both tables: (vec_id, embedding). A row with the query's own id is no candidate. Scores are double-precision inner products of
    the original vectors; ties go to the smaller vec_id. Vectors that are null, zero or hold a null or non-finite
    component take no part; a vector meets only vectors of its own dimension. Equal vectors are one entry of the index and all
    of them are found with it (k + 1 smallest ids are kept for each shard, which no result can exceed). Repeated rows count once.
    Other columns are ignored; an empty table gives no row.

    Rows are dealt to shards of about SHARD rows; each shard's forest is built once and all queries stream through it after its rows,
    so that no shard and no task's memory grows with the data; each shard sends k rows a query on.
    """
    rows, asked = _clean(vectors), _clean(queries)
    shards = max(1, -(-rows.count() // SHARD))
    base = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "vec_id", "embedding")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            shard, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, index = shard[a], [], None
                part = batch.slice(a, b - a)
                ids, own = part.column(2).to_numpy(), list(_by_dimension(*_vectors(part.column(3))))
                if not query[a]:
                    held += [(d, ids[at], m) for d, at, m in own]
                    continue
                if index is None:
                    index = {d: Shard(np.concatenate([i for e, i, _ in held if e == d]), np.concatenate([m for e, _, m in held if e == d]), trees, share, k) for d in {e for e, _, _ in held}}
                    held = []
                found = [x for d, at, m in own if d in index for x in index[d].search(ids[at], m)]
                q, v, s = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    dealt = base.unionByName(ask).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(thrifty(search), "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # limited before the shuffle too
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id 20 divides, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
