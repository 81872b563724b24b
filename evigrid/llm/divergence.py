"""Divergence of sources: how differently the sources of a language use its terms, from joint histograms of counts.

Two sources' divergence is a sum over terms of a function of two counts, and most terms share their counts with many others. So for each pair of
sources the distinct (count, count) combinations are tallied, the function is evaluated once a combination, and the value is taken as often as the
combination occurs. Combinations with a zero are not made from rows: they follow from each source's own histogram and the number of terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.llm.common import checkpointed, limit_batches, table, thrifty

#: Documents of a language in which a term has to occur, and ranks of `term` rows.
LEAST, RANKS = 30, 50
#: What p is a share of, and what each count is raised by.
UNIT, RAISE = 1_000_000_000, 5
#: Bytes to bytes: A-Z lower-cased, other ASCII characters that aren't letters to spaces, which stand between terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Counted terms that a worker holds before it hands them on, and bytes of a text that are split at a time.
HELD, SPAN = 1 << 18, 1 << 22
#: Source-by-term cells that a worker looks at together.
CELLS = 1 << 18


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in order, with repeats, a span at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + SPAN)
        to = cut if cut >= 0 else len(text)
        yield text[at:to].split()
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it, in each group. Nulls are read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in counts.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                columns += [pa.array([n[t] for t in terms], pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, in_docs = counts[lang, source]
                own: set[bytes] = set()
                held -= len(n)
                for terms in _runs(text.as_buffer().to_pybytes()):
                    n.update(terms)
                    own.update(terms)
                in_docs.update(own)
                held += len(n)
                if held > HELD:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    each = read.mapInArrow(thrifty(run), "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among `total` occurrences of `terms` kept terms, in exact arithmetic."""
    part = (count.cast("decimal(18,0)") + F.lit(RAISE)) * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", part, total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * F.lit(RAISE))


def _joint(kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): kept terms m that occur x > 0 times in source a and y > 0 times in source b, for a before b; tallied where a block of terms is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lists = batch.column(0), batch.column(1)
            sources, counts = lists.flatten().field("source").dictionary_encode(), np.asarray(lists.flatten().field("n"), np.int64)
            names, code = sources.dictionary.to_pylist(), np.asarray(sources.indices, np.int64)
            sizes = np.asarray(lists.value_lengths(), np.int64)
            lang = langs.dictionary_encode()
            term_lang, first = np.asarray(lang.indices, np.int64), np.cumsum(sizes) - sizes
            for lo in _chunks(sizes):
                at = np.repeat(first[lo], sizes[lo]) + _within(sizes[lo])
                left, right = _pairs(sizes[lo])
                a, b = at[left], at[right]
                keys = np.stack([np.repeat(term_lang[lo], sizes[lo])[left], code[a], code[b], counts[a], counts[b]])
                found, times = np.unique(keys, axis=1, return_counts=True)
                columns = [pa.DictionaryArray.from_arrays(pa.array(found[0]), lang.dictionary).cast(pa.string())]
                columns += [pa.DictionaryArray.from_arrays(pa.array(found[i]), pa.array(names, pa.string())).cast(pa.string()) for i in (1, 2)]
                columns += [pa.array(found[3]), pa.array(found[4]), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "x", "y", "m"])

    lists = kept.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s")).where(F.size("s") > 1)
    tallied = lists.select("lang", "s").mapInArrow(thrifty(run), "lang string, a string, b string, x long, y long, m long")
    return tallied.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of terms with about CELLS pairs of sources; a term of more is a run of its own."""
    pairs = np.cumsum(sizes * (sizes - 1) // 2)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + CELLS, "right")))
        yield np.arange(at, to)
        at = to


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside each run, the earlier one first."""
    later = np.repeat(sizes, sizes) - 1 - _within(sizes)
    left = np.repeat(np.arange(sizes.sum()), later)
    return left, left + 1 + _within(later)


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs (text, lang, source): the audit of every group (lang, source).

    Part `pair`: item is another source of the language, value the sum of |p - q| over the language's kept terms (0 without any). Part `term`: item is a
    kept term that the group uses more than its language does, value p - q, the first `ranks` only. Ranks go by value, largest first, then by item.
    Kept are terms in at least `least` documents of the language. A null or empty text has no terms and still makes its group occur; repeated rows count
    as often as they occur; other columns are left out; an empty table gives no row. Equal values are told apart by item, so ranks have no ties.
    Shares are exact up to 10^18 occurrences of a term.
    """
    limit_batches(docs.sparkSession)
    groups = checkpointed(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct())
    counts = term_counts(docs).withColumn("in_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("in_docs") >= least)
    kept = checkpointed(counts.select("lang", "source", "term", "n"))
    terms = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_n"))
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(terms, "lang", "left")
    totals = checkpointed(totals.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_n"))))
    return _pair_rows(kept, totals).unionByName(_term_rows(kept, totals, ranks))


def _pair_rows(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """The `pair` part: each unordered pair of sources is summed up once and handed to both."""
    joint = checkpointed(_joint(kept))
    a, b = (totals.select("lang", F.col("source").alias(s), F.col("total").alias(f"{s}_total"), *(["v"] if s == "a" else [])) for s in "ab")
    pairs = a.join(b, "lang").where("a < b")  # the rows that the result has, once for both directions
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    one = own.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), "m").join(pairs.select("lang", "a", "b"), ["lang", "a"]).select("lang", "a", "b", "x", F.lit(0).alias("y"), "m")
    other = own.select("lang", F.col("source").alias("b"), F.col("n").alias("y"), "m").join(pairs.select("lang", "a", "b"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).alias("x"), "y", "m")
    both = joint.select("lang", "a", "b", "x", "y", F.explode(F.array(F.struct("x", "y", "m"), F.struct("x", F.lit(0).cast("long").alias("y"), (-F.col("m")).alias("m")), F.struct(F.lit(0).cast("long").alias("x"), "y", (-F.col("m")).alias("m")))).alias("c"))
    # a term in both sources is in neither one's cells with a zero: it is taken off again there
    cells = both.select("lang", "a", "b", "c.x", "c.y", "c.m").unionByName(one).unionByName(other).groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))
    shown = cells.where("m > 0").join(pairs, ["lang", "a", "b"])
    f = F.abs(_share(F.col("x"), F.col("a_total"), F.col("v")) - _share(F.col("y"), F.col("b_total"), F.col("v")))
    sums = shown.groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("seen"), F.sum("m").alias("cells"))
    rest = F.col("v") - F.coalesce("cells", F.lit(0))  # terms in neither source
    nowhere = F.abs(_share(F.lit(0), F.col("a_total"), F.col("v")) - _share(F.lit(0), F.col("b_total"), F.col("v")))
    value = F.coalesce("seen", F.lit(0)) + F.when(rest > 0, nowhere * rest).otherwise(0)
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    rows = valued.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return rows.withColumn("rank", F.row_number().over(_order()))


def _term_rows(kept: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    """The `term` part."""
    in_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_count"))
    rows = kept.join(in_lang, ["lang", "term"]).join(totals, ["lang", "source"])
    value = _share(F.col("n"), F.col("total"), F.col("v")) - _share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.cast("long").alias("value")).where("value > 0")
    return rows.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= ranks)


def _order() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT lang, source, k, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM e GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
v AS (SELECT g.lang, count(term) AS v, coalesce(sum(in_lang), 0) AS n FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
  FROM s JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
FROM r WHERE part = 'pair' OR rank <= 50
"""
