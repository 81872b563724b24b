"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score, so that
P(grade >= j) = sigmoid(score - threshold_j). Documents are selected by the probability of the best grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import give_back, table, thrifty
from evigrid.llm.hashing import U, mix, pieces, words

#: Hash slots for words and for runs of punctuation, and slots for the binned shares that follow them.
SLOTS = 1 << 18
_BINS, _SHARES = 20, 6
#: Labelled documents that the model is fitted on, at most, chosen by a hash of doc_id: a documented bound on driver memory.
SAMPLE = 20_000
#: Rows of the sample that are multiplied at a time.
ROWS = 1024
#: Features get a weight from so many documents of the sample on, and from one in so many.
RARE, RARE_SHARE = 4, 800

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text: words and punctuation runs that occur, and bins of shares.

    A feature is present or absent, so that one telling word weighs the same in a short and in a long text.
    Shares: distinct words, capitals, punctuation, digits, words that carry punctuation, length (log).
    """
    for _, offsets, data in pieces(column):
        alnum = _ALNUM[data] if len(data) else np.zeros(0, bool)
        hashes, begin = words(offsets, data, ~_ALNUM)
        marks, mark_begin = words(offsets, data, _ALNUM | _BLANK)
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        punct = np.concatenate([[0], np.cumsum(~alnum & ~_BLANK[data])]) if len(data) else np.zeros(1, np.int64)
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            own = np.unique(hashes[begin[i] : begin[i + 1]])
            n, size = begin[i + 1] - begin[i], max(1, b - a)
            shares = (
                len(own) / max(1, n),
                (upper[b] - upper[a]) / size,
                min(1.0, 4 * (punct[b] - punct[a]) / size),
                min(1.0, 4 * (digit[b] - digit[a]) / size),
                min(1.0, (mark_begin[i + 1] - mark_begin[i]) / max(1, n)),
                min(1.0, np.log1p(n) / 12),
            )
            other = np.unique(marks[mark_begin[i] : mark_begin[i + 1]])
            yield np.concatenate(
                [
                    np.unique(np.concatenate([own, mix(other)]) & U(SLOTS - 1)).astype(np.int64),
                    np.array([SLOTS + k * _BINS + min(_BINS - 1, int(x * _BINS)) for k, x in enumerate(shares)], np.int64),
                ]
            )


@dataclass(frozen=True)
class Model:
    """weights over all slots; thresholds[j] is where grade j + 1 begins."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j + 1) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in found])


def fit(found: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 400, decay: float = 1e-4, step: float = 0.05) -> Model:
    """Maximum likelihood by Adam. Thresholds stay ordered: the first is free, the others are exponentials of gaps.

    With fewer than two grades among the rows the weights stay zero and the thresholds give the observed shares.
    """
    size = SLOTS + _BINS * _SHARES
    n = len(found)
    shares = [(np.count_nonzero(grades >= j) + 0.5) / (n + 1) for j in range(1, levels)]
    start = np.array([-np.log(p / (1 - p)) for p in shares])
    start = np.maximum.accumulate(start + np.arange(levels - 1) * 1e-6)
    if n == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(size), start)
    counts = np.zeros(size, np.int64)
    for at in range(0, n, ROWS):
        counts += np.bincount(np.concatenate(found[at : at + ROWS]), minlength=size)
    used = np.flatnonzero(counts >= min(max(RARE, n // RARE_SHARE), n))
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(len(used))
    blocks = []
    for at in range(0, n, ROWS):
        flat, row = number[np.concatenate(found[at : at + ROWS])], np.repeat(np.arange(at, min(n, at + ROWS), dtype=np.int32), [len(x) for x in found[at : at + ROWS]])
        blocks.append((slice(at, min(n, at + ROWS)), flat[flat >= 0], row[flat >= 0] - at))
    parameters = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    w = len(used)
    for t in range(1, rounds + 1):
        cuts = parameters[w] + np.concatenate([[0], np.cumsum(np.exp(parameters[w + 1 :]))])
        score = np.concatenate([np.bincount(row, weights=parameters[flat], minlength=own.stop - own.start) for own, flat, row in blocks])
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        slope = tail * (1 - tail)
        edges = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        slopes = np.hstack([np.zeros((n, 1)), slope, np.zeros((n, 1))])
        at = np.arange(n)
        chance = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        by_cut = np.zeros((n, levels + 1))
        by_cut[at, grades] += slopes[at, grades] / chance
        by_cut[at, grades + 1] -= slopes[at, grades + 1] / chance
        by_score = -by_cut.sum(axis=1) / n
        cut_gradient = by_cut[:, 1:-1].sum(axis=0) / n
        gaps = np.exp(parameters[w + 1 :])
        by_weight = decay * parameters[:w]
        for own, flat, row in blocks:
            by_weight += np.bincount(flat, weights=by_score[own][row], minlength=w)
        gradient = np.concatenate([by_weight, [cut_gradient.sum()], [cut_gradient[i + 1 :].sum() * gaps[i] for i in range(levels - 2)]])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = parameters[:w]
    return Model(weights, parameters[w] + np.concatenate([[0], np.cumsum(np.exp(parameters[w + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good; of repeated labels the lowest. Rows with a null count as not labelled."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min(F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)).alias("grade"))


def trained(docs: DataFrame, ratings: DataFrame, levels: int = 3, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rated documents (doc_id, grade 0 to levels - 1); which ones depends on hashes of their ids only.

    Features are made where the documents are; the driver gets feature numbers, not texts.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "found"])

    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # at most `sample` rows of two numbers
    rows = rated.mapInArrow(thrifty(run), "doc_id long, grade int, found array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    grades = rows.column("grade").to_numpy().astype(np.int64)
    found = [x.values.to_numpy() for chunk in rows.column("found").chunks for x in chunk]  # views, no copies
    model = fit(found, grades, levels)
    del rows, found
    give_back()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, with expected_grade and p_best, the probability of the best grade.

    A null or empty text is scored by its length's weight alone. Rows are judged one by one.
    Columns named like the two would clash and are refused.
    """
    if clash := {"expected_grade", "p_best"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = given.value.tails(given.value.scores(list(features(batch.column(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*batch.schema.names, "expected_grade", "p_best"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(thrifty(run), StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("p_best", DoubleType())]))


#: A document is kept when its best grade is at least this likely.
KEEP = 0.5


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, graded(table(spark, sf_dir, "labels")))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("p_best", 9).alias("p_best"), (F.col("p_best") >= KEEP).alias("kept"))
