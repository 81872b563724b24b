"""Near-duplicate lines by a deletion-neighbourhood join on edit distance 1.

Every line that can have a neighbour emits itself and itself without each one of its characters, as hashed keys; lines that
share a key meet, the distance of what meets is verified, and the earliest line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import BITMAP_BITS, bit_of, bitmap, checkpointed, in_bitmap, lent, table, thrifty
from evigrid.llm.hashing import POWERS, U, mix, prefix_sums, slices

#: The edit bound is a share of a line: one edit in so many characters. Shorter lines have copies at distance 0 only.
LEAST_CHARS = 10
#: Parts of a line, one of which holds the edit: variants are emitted only for parts that another line could differ in.
BLOCKS = 8
#: Characters hashed at a time.
_PIECE = 1 << 18
#: Scrambled code points of the first planes' common part; others are scrambled when met.
_COMMON = mix(np.arange(1, 0x3001, dtype=U))


def normal(line: str) -> str:
    """What is compared: without white space at the ends, lower-cased."""
    return line.strip().lower()


def _pieces(texts: list[str | None], least: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Text numbers, line numbers and normal forms of the lines of `least` characters or more, in runs of bounded size."""
    docs, numbers, lines, size = [], [], [], 0
    for d, text in enumerate(texts):
        if not text:
            continue
        for i, line in enumerate(text.split("\n")):
            line = normal(line)
            if len(line) < least:
                continue
            docs.append(d)
            numbers.append(i)
            lines.append(line)
            size += len(line)
            if size >= _PIECE:
                yield docs, numbers, lines
                docs, numbers, lines, size = [], [], [], 0
    if lines:
        yield docs, numbers, lines


def _sums(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums over the scrambled code points of all lines in a row, and each line's start and end."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _COMMON[points] if not len(points) or points.max() < len(_COMMON) else mix(points.astype(U) + U(1))
    ends = np.cumsum([len(x) for x in lines])
    return prefix_sums(codes), np.concatenate([[0], ends[:-1]]), ends


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, U).view(np.int64))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, line, h, keys): a line's hash, and the four keys of which it shares one with any line one edit away.

    One edit leaves the first or the last half of the shorter line as it is; so the halves are taken by the line's own
    length and, for a neighbour one shorter, by the length below. All lines but blank ones have a hash; repeats of a line
    inside a piece and lines of fewer than `least` characters carry no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for docs_, numbers, lines in _pieces(batch.column(1).to_pylist(), 1):
                sums, start, end = _sums(lines)
                n = end - start
                h = slices(sums, start, end)
                new = np.zeros(len(h), bool)
                new[np.unique(h, return_index=True)[1]] = True
                new &= n >= least
                half, below = n // 2, (n - 1) // 2
                salt = [U(0x632BE59BD9B4E019), U(0x85157AF5D1B4C3A7)]
                own, under = n.astype(U), (n - 1).astype(U)
                keys = np.stack(
                    [
                        mix(slices(sums, start, start + half) + own * salt[0]),
                        mix(slices(sums, start + half, end) + own * salt[1]),
                        mix(slices(sums, start, start + below) + under * salt[0]),
                        mix(slices(sums, start + below + 1, end) + under * salt[1]),
                    ],
                    axis=1,
                ).ravel()
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, 4, dtype=np.int32)), _signed(keys))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs_)), pa.array(numbers, pa.int32()), _signed(h), pc.if_else(pa.array(new), keys, None)], ["doc_id", "line", "h", "keys"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id long, line int, h long, keys array<long>")


def _spot(doc, line):
    """A bitmap position for a place, as _spot_of has it for columns."""
    return ((doc & 0x7FFFFFFF) * 31 + line) & (BITMAP_BITS - 1)


def _spot_of(doc: Column, line: Column) -> Column:
    return (doc.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) * 31 + line).bitwiseAND(F.lit(BITMAP_BITS - 1).cast("long"))


def _texts(docs: DataFrame, least: int, wanted_docs, wanted_lines) -> DataFrame:
    """(h, doc_id, line, text, keys) of the lines whose places the bitmaps let pass.

    keys: two for each of BLOCKS parts, one of which is shared with any line one edit away: the line without that part, which
    holds the edit, by its own length and, for a neighbour one shorter, by the length below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(in_bitmap(wanted_docs.value, batch.column(1).to_numpy())))
            ids = some.column(0).to_numpy()
            for docs_, numbers, lines in _pieces(some.column(2).to_pylist(), least):
                doc, line = ids[docs_], np.array(numbers, np.int64)
                take = np.flatnonzero(in_bitmap(wanted_lines.value, _spot(doc, line)))
                if not len(take):
                    continue
                lines = [lines[i] for i in take]
                sums, start, end = _sums(lines)
                n = end - start
                keys = []
                for size, more in ((n, 0), (n - 1, 1)):
                    for j in range(BLOCKS):
                        front, back = j * size // BLOCKS, (j + 1) * size // BLOCKS + more
                        keys.append(mix(slices(sums, start, start + front) ^ mix(slices(sums, start + back, end) + size.astype(U) * U(BLOCKS) + U(j))))
                keys = np.stack(keys, axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [_signed(slices(sums, start, end)), pa.array(doc[take]), pa.array(line[take].astype(np.int32)), pa.array(lines), pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, 2 * BLOCKS, dtype=np.int32), _signed(keys))],
                    ["h", "doc_id", "line", "text", "keys"],
                )

    return docs.select("doc_id", bit_of(F.xxhash64("doc_id")).alias("bit"), "text").mapInArrow(thrifty(run), "h long, doc_id long, line int, text string, keys array<long>")


def _sharing(keyed: DataFrame) -> DataFrame:
    """(h, part): the keys of rows (h, keys), by their place in the array, that another h has too."""
    each = keyed.select("h", F.posexplode("keys").alias("part", "key")).repartition("key")
    shared = each.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("key")
    return each.join(shared, "key", "left_semi").select("h", "part")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, own, h, first): the line itself (own 1) and the line without one character of a part that could hold an edit.

    Two lines of one length are one edit apart when the same place left out makes them equal (own 2: such keys hold the
    place); of two lengths, when one is the other without a character (own 0, which meets own 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = POWERS.upto(2)[1][1]
        salt = U(0xD6E8FEB86659FD93)
        for batch in batches:
            keys, owns, hs, at = [], [], [], []
            for i, (h, text, parts) in enumerate(zip(batch.column(0).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                sums, _, _ = _sums([text])
                n = len(text)
                found = []
                if any(j < BLOCKS for j in parts):
                    found.append((mix(sums[n:] + np.array([n], U) * salt), 1))
                for j in sorted(set(parts)):
                    size, more = (n, 0) if j < BLOCKS else (n - 1, 1)
                    place = np.arange(j % BLOCKS * size // BLOCKS, min(n, (j % BLOCKS + 1) * size // BLOCKS + more))
                    left = mix(sums[place] + (sums[n] - sums[place + 1]) * inverse + np.array([n - 1], U) * salt)
                    found.append((mix(left ^ mix(place.astype(U) + U(0x3C79AC492BA7B653))), 2) if j < BLOCKS else (np.unique(left), 0))
                for k, own in found:
                    keys.append(k)
                    owns.append(np.full(len(k), own, np.int8))
                    hs.append(np.full(len(k), h))
                    at.append(np.full(len(k), i))
            if keys:
                first = batch.column(1).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(owns)), pa.array(np.concatenate(hs)), first], ["key", "own", "h", "first"])

    return lines.select("h", "first", "text", "parts").mapInArrow(thrifty(run), "key long, own tinyint, h long, first struct<doc_id:long,line:int>")


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, line) of every line of docs (doc_id, text) that goes, numbered from 0 in texts split at newlines.

    A line goes when an earlier one, by (doc_id, line), is equal or, both having `least` characters or more, one edit (a character
    put in, left out or changed) away, in normal form: white space at the ends dropped, lower-cased. Blank lines stay.

    Equal lines are one class with its earliest place. Only classes that share half of themselves with another can have a
    neighbour, of those only the ones that are equal but for one part, and only they emit variants, for that part. For each key the earliest classes are aggregated, never its pairs; what
    meets is verified with the edit distance of the texts. Texts of null or no characters have no lines; rows with a null doc_id
    keep all lines; rows of one doc_id are one document, whose equal line numbers are one place; an empty table gives no row.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = checkpointed(_lines(docs, least))
    first = F.min(F.struct("doc_id", "line")).alias("first")
    classes = lines.groupBy("h").agg(first, F.count("*").alias("n"))
    able = checkpointed(_sharing(lines.where("keys IS NOT NULL")).select("h").distinct().join(classes, "h").select("h", "first.*"))
    if able.isEmpty():  # no two lines share a key
        return _repeats(lines, classes, spark.createDataFrame([], "h long, near boolean"))
    with lent(spark, bitmap(able, bit_of(F.xxhash64("doc_id")))) as documents, lent(spark, bitmap(able, _spot_of(F.col("doc_id"), F.col("line")))) as places:
        found = checkpointed(able.join(_texts(docs, least, documents, places), ["h", "doc_id", "line"]).groupBy("h").agg(first, F.first("text").alias("text"), F.first("keys").alias("keys")))
    texts = checkpointed(_sharing(found).groupBy("h").agg(F.collect_set("part").alias("parts")).join(found, "h").select("h", "first", "text", "parts"))
    keys = _variants(texts).repartition("key")
    held = F.struct("first", "h")
    met = (
        keys.groupBy("key")
        .agg(F.min(F.when(F.col("own") == 0, held)).alias("shortened"), F.min(F.when(F.col("own") == 1, held)).alias("whole"), F.min(F.when(F.col("own") == 2, held)).alias("changed"), F.count("*").alias("n"))
        .where("n > 1")
    )
    other = F.when(F.col("own") == 0, F.col("whole")).when(F.col("own") == 1, F.col("shortened")).otherwise(F.col("changed"))
    pairs = keys.join(met, "key").select("h", "first", other.alias("o")).where("o IS NOT NULL AND o.first < first").select("h", F.col("o.h").alias("earlier")).distinct()
    pairs = pairs.join(texts.select("h", F.col("text").alias("t")), "h").join(texts.select(F.col("h").alias("earlier"), F.col("text").alias("u")), "earlier")
    near = pairs.where(F.levenshtein("t", "u", 1) >= 0).select("h").distinct().withColumn("near", F.lit(True))
    return _repeats(lines, classes, near)


def _repeats(lines: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, line) of the lines that are no first one of their class, or of a class near an earlier one."""
    judged = classes.where("n > 1").select("h", "first").join(near, "h", "full_outer")
    gone = lines.select("doc_id", "line", "h").join(judged, "h").where(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "line") > F.col("first")))
    return gone.select("doc_id", "line")


def deduplicated(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """docs, all columns, with text without its repeated lines, and the numbers n_lines and n_dropped; see repeated_lines.

    A null text stays null, with no lines. Columns named n_lines, n_dropped, _gone or _parts would clash and are refused.
    """
    if clash := {"n_lines", "n_dropped", "_gone", "_parts"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    gone = repeated_lines(docs, least).groupBy("doc_id").agg(F.array_distinct(F.collect_list("line")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    rows = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left").drop("_gone_id")
    rows = rows.withColumn("_parts", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n"))
    n_lines = F.when(F.length("text") > 0, F.size("_parts")).otherwise(0).cast("long")
    out = rows.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "text": kept})
    return out.select(*docs.columns, "n_lines", F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many lines each has and loses, and the digest of the text that stays."""
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
