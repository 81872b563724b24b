"""Fill-in-the-middle: prefix, middle and suffix of a text, cut at token ends and put in another order.

One numpy kernel cuts all texts of an Arrow batch together, on the bytes of its UTF-8 buffer: a byte-class lookup, a mask of the bytes that end a
token (a byte against the next one), a running count of token ends less the count at each document's start, and one searchsorted for all cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import limit_batches, table, thrifty

#: Fixed marks before the parts; a text that holds one stays as it is.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 documents, how many are not plain, and of those, how many have the suffix first (spm).
RATE, SUFFIX_FIRST = 50, 80

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a code point.
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column, the first offset being 0."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _counts(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all: one more than mask has."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:], dtype=out.dtype)
    return out


def _token_ends(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which bytes end a token: a word, with the white space before it, or the white space that ends a text."""
    white = _WHITE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~white[:-1] & white[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return ends


def _marked(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which texts hold a mark."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])) if len(data) > 2 else np.zeros(0, np.int64)
    last = np.searchsorted(at, offsets[1:] - 2)  # marks that end inside the text
    return last > np.searchsorted(at, offsets[:-1])


def cut(column: pa.Array, draws: np.ndarray) -> dict[str, np.ndarray]:
    """For texts and their draws (rows, 4) of unsigned integers: tokens n, form (0 plain, 1 psm, 2 spm), and the bytes and code points where prefix and middle end."""
    offsets, data = _buffer(column)
    before = _counts(_token_ends(offsets, data))
    start = before[offsets[:-1]].astype(np.int64)
    n = before[offsets[1:]] - start
    units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    place = np.searchsorted(before, start[:, None] + units)
    place = np.maximum(place, offsets[:-1, None])  # no unit: the text's own start, not the end of one before
    form = np.where(draws[:, 3] % 100 < SUFFIX_FIRST, 2, 1)
    form[(np.diff(offsets) == 0) | _marked(offsets, data) | (draws[:, 2] % 100 >= RATE)] = 0
    points = _counts(_BEGINS[data])
    ends = points[place].astype(np.int64) - points[offsets[:-1]][:, None]
    return {"n": n, "form": form, "cuts": place - offsets[:-1, None], "prefix_chars": ends[:, 0], "middle_chars": ends[:, 1] - ends[:, 0]}


FORMS = ("plain", "psm", "spm")


def arranged(text: bytes, form: int, prefix: int, middle: int) -> bytes:
    """The text's parts in their form; prefix and middle are the bytes where they end."""
    if form == 0:
        return text
    parts = memoryview(text)
    head, tail = (PREFIX, parts[:prefix]), (SUFFIX, parts[middle:])
    return b"".join([*(head + tail if form == 1 else tail + head), MIDDLE, parts[prefix:middle]])


def draws(doc_id: Column) -> Column:
    """Four unsigned 32-bit integers of a document: the first groups of eight digits of a sha256; a null doc_id is drawn as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def infilled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text, output) for docs (doc_id, text), one row each.

    n: the text's tokens. form: plain (the text as it is; prefix_chars and middle_chars are null), psm or spm. A null text is an empty one and plain;
    repeated rows give repeated rows; other columns are left out; an empty table gives no row. A text of any length is cut whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            drawn = np.array(batch.column(2).flatten(), np.int64).reshape(-1, 4)
            got = cut(texts, drawn)
            rows = zip(texts, got["form"].tolist(), got["cuts"].tolist(), strict=True)
            output = pa.array([arranged(t.as_py(), form, *at) for t, form, at in rows], pa.large_binary())
            plain = got["form"] == 0
            columns = [batch.column(0), pa.array(got["n"].astype(np.int64)), pa.array([FORMS[f] for f in got["form"].tolist()]), pa.array(got["prefix_chars"], mask=plain), pa.array(got["middle_chars"], mask=plain)]
            columns += [x.cast(pa.large_utf8()).cast(pa.utf8()) for x in (texts, output)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "text", "output"])

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", draws(F.col("doc_id").cast("long")).alias("draws"))
    return rows.mapInArrow(thrifty(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, text string, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: no part holds a mark, so each mark is the first one after the last."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    second = F.when(form == "psm", s).otherwise(p)
    size, one = F.lit(len(MIDDLE)), F.lit(1)
    body = F.substr(output, size + 1)
    first = F.split_part(body, second, one)
    rest = F.substr(body, F.char_length(first) + size + 1)
    last = F.split_part(rest, m, one)
    middle = F.substr(rest, F.char_length(last) + size + 1)
    return F.when(form == "plain", output).otherwise(F.when(form == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; digests of what is put out and of what is read back from it."""
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored(F.col("output"), F.col("form")))]
    return infilled(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
u AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:n], '') AS s FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
