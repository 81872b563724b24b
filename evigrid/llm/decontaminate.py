"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words, not characters, are its letters: every word of the benchmark gets a code, every other word one common code,
so that a document is scanned in one pass of one step a word and hits carry word numbers, which map back to offsets.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import table, thrifty

#: Consecutive item words that make a window.
WINDOW = 13
#: Bytes of benchmark text for one automaton, which takes some 150 times as much memory in each worker; a larger benchmark goes in blocks.
BLOCK_BYTES = 1 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {i: i + 32 for i in range(65, 91)}
#: For UTF-8 bytes: A-Z lower-cased, other ASCII characters outside words made white space; bytes from 0x80 belong to words.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def offsets_of(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words of words_of, in the original text."""
    return [m.span() for m in _WORD.finditer(text.translate(_FOLD))]


class Automaton:
    """All windows of all items. A window may belong to several items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        owners: dict[str, set[int]] = {}
        for item, text in items:
            ws = words_of(text)
            letters = "".join(self._code(w) for w in ws)
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                owners.setdefault(letters[i : i + window], set()).add(item)
        self.machine = ahocorasick.Automaton()
        for letters, who in owners.items():
            self.machine.add_word(letters, (len(letters), tuple(who)))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def _code(self, word: bytes) -> str:
        """One character for each word, from U+0100 on and without the surrogates."""
        if (c := self.codes.get(word)) is None:
            n = 0x100 + len(self.codes)
            c = self.codes[word] = chr(n if n < 0xD800 else n + 0x800)
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs of hit words (first, end), and the items found."""
        if not self.any or not ws:
            return [], set()
        get = self.codes.get
        letters = "".join([get(w, "\x01") for w in ws])
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (length, who) in self.machine.iter(letters):
            items.update(who)
            a, b = end - length + 1, end + 1
            while runs and runs[-1][1] >= a:
                a = min(a, runs.pop()[0])
            runs.append((a, b))
        return runs, items


def _segments(item: int, text: str | None, window: int) -> Iterator[tuple[int, str | None]]:
    """The item, or, of a very long one, runs of its words that overlap by window - 1 words: together they have the same windows."""
    if len(text or "") * 4 <= BLOCK_BYTES or len(ws := words_of(text)) <= window:
        yield item, text
        return
    most = max(1, BLOCK_BYTES // (1 + max(map(len, ws))), len(ws) * BLOCK_BYTES // (4 * len(text)))
    for at in range(0, len(ws) - window + 1, most):
        yield item, b" ".join(ws[at : at + most + window - 1]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items, in blocks dealt by a hash of their ids, one after another on the driver; a block of very long items is split."""
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL")
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")
    n = max(1, -(-2 * rows.agg(size).first()[0] // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    for own in rows.groupBy(block.alias("i")).agg(size).orderBy("i").collect():
        now, held = [], 0
        for item, text in (x for r in rows.where(block == own["i"]).collect() for x in _segments(r[0], r[1], window)):
            if now and held + len(text or "") > 2 * BLOCK_BYTES:
                yield now
                now, held = [], 0
            now.append((item, text))
            held += len(text or "")
        yield now


_kept: dict[str, Automaton] = {}


def _built(name: str, items: Broadcast | None, window: int) -> Automaton:
    """The automaton of that name: a worker builds it once for all its tasks and keeps no other."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Automaton(items.value if items else [], window)
    return _kept[name]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, end) in any order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, Callable]:
    """docs, and what makes, once a task, a function from a batch to (text, words, runs, items) of each row.

    A benchmark of one block is scanned for right there. Of several blocks, each scans the documents by itself; their hits, by doc_id
    and a hash of the text, are joined to docs as two more columns, and the function only merges them.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, window)]
    name = uuid.uuid4().hex

    def direct() -> Callable:
        automaton = _built(f"{name} 0", blocks[0] if blocks else None, window)

        def scan(batch: pa.RecordBatch) -> Iterator[tuple]:
            for text in batch.column("text"):
                text = text.as_py() or ""
                ws = words_of(text)
                yield (text, ws, *automaton.scan(ws))

        return scan

    if len(blocks) < 2:
        return docs, direct

    def hits(i: int, items: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built(f"{name} {i}", items, window)
            for batch in batches:
                found = [(i, *x) for i, text in enumerate(batch.column(2)) if (x := automaton.scan(words_of(text.as_py())))[0]]
                at = pa.array([i for i, _, _ in found], pa.int64())
                runs = pa.array([[{"first": a, "end": b} for a, b in r] for _, r, _ in found], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), runs, pa.array([[str(x) for x in who] for _, _, who in found], pa.list_(pa.string()))], ["_id", "_key", "_runs", "_items"])

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    schema = "_id long, _key long, _runs array<struct<first:long,end:long>>, _items array<string>"
    rows = reduce(DataFrame.unionByName, [texts.mapInArrow(thrifty(hits(i, b)), schema).withColumn("_block", F.lit(i)) for i, b in enumerate(blocks)])
    own = rows.dropDuplicates(["_id", "_key", "_block"]).groupBy("_id", "_key").agg(F.flatten(F.collect_list("_runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))

    def joined() -> Callable:
        def scan(batch: pa.RecordBatch) -> Iterator[tuple]:
            for text, runs, who in zip(batch.column("text"), batch.column("_runs").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                text = text.as_py() or ""
                yield text, words_of(text), merged([(r["first"], r["end"]) for r in runs or []]), set(who or [])

        return scan

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(own, same, "left").select(*docs.columns, "_runs", "_items"), joined


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) for each row of docs (doc_id, text).

    A word is hit when it lies in an occurrence of a window (`window` consecutive words of an item; a shorter item is
    one window). items: the item_ids found, sorted as strings. spans: character offsets of hit runs in the original text.
    contaminated: some word is hit, and at least `percent` percent of the words are. Null or empty text: no words.
    Null item_ids and items without words have no windows; an empty benchmark hits nothing. Repeated rows give repeated rows.
    """
    rows, maker = _scanned(docs.select("doc_id", "text"), benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = maker()
        for batch in batches:
            out: list[tuple] = []
            for text, ws, runs, found in scan(batch):
                spans = []
                if runs:
                    at = offsets_of(text)
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]
                hit = sum(b - a for a, b in runs)
                out.append((len(ws), hit, len(found), sorted(map(str, found)), spans, hit > 0 and 100 * hit >= percent * len(ws)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(thrifty(run), "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """docs, all columns, without the contaminated rows, by the rule of contamination().

    Columns named _id, _key, _runs or _items would clash and are refused.
    """
    if clash := {"_id", "_key", "_runs", "_items"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash with the operator's own")
    rows, maker = _scanned(docs, benchmark, window)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = maker()
        for batch in batches:
            take = []
            for _, ws, runs, _ in scan(batch):
                hit = sum(b - a for a, b in runs)
                take.append(not (hit and 100 * hit >= percent * len(ws)))
            yield batch.select(names).filter(pa.array(take, pa.bool_()))

    return rows.mapInArrow(thrifty(keep), docs.schema)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH f AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM f),
win AS (SELECT DISTINCT id AS item, CASE WHEN len(ws) < 13 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 12], ' ') END AS t, least(len(ws), 13) AS n
  FROM (SELECT id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM w WHERE k = 'b' AND len(ws) > 0)),
ats AS (SELECT id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w WHERE k = 'd'),
pos AS (SELECT ats.id, ats.i, n.n, array_to_string(ws[ats.i : ats.i + n.n - 1], ' ') AS t FROM ats, (SELECT DISTINCT n FROM win) n WHERE ats.i + n.n - 1 <= len(ws)),
hit AS (SELECT pos.id, pos.i, pos.n, win.item FROM pos JOIN win ON pos.t = win.t AND pos.n = win.n),
cov AS (SELECT id, count(DISTINCT j) AS h FROM (SELECT id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY id),
it AS (SELECT id, count(DISTINCT item) AS c, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS s FROM hit GROUP BY id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h, 0) AS BIGINT) AS n_hit, CAST(coalesce(c, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov ON cov.id = w.id LEFT JOIN it ON it.id = w.id WHERE w.k = 'd'
"""
