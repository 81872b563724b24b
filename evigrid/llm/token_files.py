"""Token ids in binary files: blocks of ids under a context-mixing range coder, each one checksummed and readable alone.

A block's bytes, little-endian: a head (magic, crc32 of all that follows, crc32 of the ids as 32-bit integers, numbers of ids, pieces,
alphabet bytes and words), its pieces (which ids of which document), the alphabet (gaps of the sorted distinct ids; 255 means more to come)
and the coder's words. Spark writes the blocks as rows of Parquet files, one file a range of documents, so that a lost task is done
again, readers split the work as they do with any table, and neither side needs a file system other than Spark's.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.llm.common import limit_batches, shared_folder, table, thrifty
from evigrid.llm.context_coder import BLOCK, WAVE, decoded, encoded
from evigrid.llm.hashing import mix, prefix_sums, slices

#: Fixed values of the file format.
MAGIC = 0x32584D43
_HEAD = np.dtype([("magic", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4"), ("ids", "<u4"), ("pieces", "<u4"), ("alphabet", "<u4"), ("words", "<u4")])
_PIECE = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ordinal", "<i8"), ("begin", "<i8"), ("first", "<i8"), ("length", "<u4"), ("last", "u1")])
_AFTER_CRC = 8

#: Strings whose ids a worker remembers, at most (some 80 MB); then only those stay that were met again, up to half as many.
STRINGS = 1_000_000
#: A text is tokenised in pieces of about so many bytes, cut at white space.
SPAN = 1 << 20
#: Texts are tokenised together up to so many bytes, as a step of numpy costs the same for a short text as for some thousand letters.
TOGETHER = 1 << 16
_SPACE = re.compile(rb"[\t-\r ]")
_ASCII_SPACE = re.compile("[\t-\r ]+")
# Classes of bytes (0 white space, 1 letters, 2 digits, 3 signs, 4 others) and contractions, by which the vocabulary's file splits text. Letters
# from U+00C0 to U+00FF are two bytes, the first of which is 0xC3.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[[*range(9, 14), 32]] = 0
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_KIND = _CLASS.tobytes()
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FOLLOWING = bytes(range(0x80, 0xC0))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _lowered(text: bytes) -> np.ndarray | None:
    """The bytes of a text of ASCII and letters up to U+00FF, lower-cased; None for other texts."""
    leads = text.count(b"\xc3")
    if b"\4" in text.translate(_KIND) or b"<|" in text or len(text) - len(text.translate(None, _FOLLOWING)) != leads:  # other characters
        return None
    low = np.frombuffer(text.translate(_LOWER), np.uint8)
    if leads:
        low = low.copy()
        lead = np.flatnonzero(low == 0xC3)
        then = low[lead + 1]
        if ((then | 32) == 0xB7).any():  # the signs for times and division
            return None
        low[lead[then < 0x9F] + 1] += 32
    return low


def _pre_tokens(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of a lowered text begin and end: contractions, runs of letters, single digits, runs of signs."""
    kinds = np.frombuffer(low.tobytes().translate(_KIND), np.uint8)
    begins = np.empty(len(low), bool)
    begins[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == 2
    quotes = np.flatnonzero(begins & (low == ord("'")))
    if len(quotes):
        padded = np.concatenate([low, np.zeros(3, np.uint8)])
        for c in map(str.encode, _CONTRACTIONS):
            at = quotes[np.all([padded[quotes + 1 + i] == b for i, b in enumerate(c)], axis=0)]
            begins[at + 1] = False
            rest = at + 1 + len(c)
            begins[rest[rest < len(low)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(low))
    words = kinds[start] != 0
    return start[words], end[words]


class RememberingTokenizer:
    """Ids of the tokenizers library for a vocabulary that drops white space; what was tokenised once is remembered.

    A piece of plain characters is split into the library's own pre-tokens, all at once; their 64-bit hashes are looked up in an open table, and the
    library's model gets each new one once. In other pieces the strings between ASCII white space go to the whole library, each once: their ids
    do not depend on what stands around them, as neither normalisation nor a token reaches over white space.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.model = self.library.model
        self.written = str.maketrans({chr(byte): letter for byte, letter in _stand_ins().items() if byte != 10})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.places = 1 << 16
        self.hashes, self.codes = np.zeros(self.places, np.uint64), np.zeros(self.places, np.int32)
        self.n, self.filled = 0, 0
        self.begin, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.again = np.zeros(1 << 12, bool)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds the hash; else it is free) of each hash in the open table."""
        at = (hashes & np.uint64(self.places - 1)).astype(np.int64)
        held = self.hashes.take(at)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.places - 1)
            held[open_] = self.hashes.take(at[open_])
            open_ = open_[(held[open_] != hashes[open_]) & (held[open_] != 0)]
        return at, held == hashes

    def _put(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        """Add hashes that the table lacks; those that meet at a place go on one by one."""
        while len(hashes):
            at, _ = self._find(hashes)
            _, first = np.unique(at, return_index=True)
            self.hashes[at[first]], self.codes[at[first]] = hashes[first], codes[first]
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, codes = hashes[rest], codes[rest]

    def _learn(self, hashes: np.ndarray, strings: list[bytes]) -> None:
        """Strings without white space, and their hashes."""
        found = list(map(self.model.tokenize, b"\n".join(strings).decode("latin-1").translate(self.written).split("\n")))
        self._add(hashes, np.array([len(x) for x in found], np.int64), np.array([t.id for x in found for t in x], np.uint32))

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remember strings by their hashes, numbers of ids, and ids one after another."""
        end, filled = self.n + len(sizes), self.filled + len(ids)
        for name, most in (("begin", end), ("size", end), ("again", end), ("ids", filled)):
            held = getattr(self, name)
            if most > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(most, 2 * len(held)) - len(held), held.dtype)]))
        self.begin[self.n : end] = self.filled + np.cumsum(sizes) - sizes
        self.size[self.n : end] = sizes
        self.ids[self.filled : filled] = ids
        if 2 * end > self.places:
            kept, codes = self.hashes[self.hashes != 0], self.codes[self.hashes != 0]
            self.places = 1 << (2 * end).bit_length()
            self.hashes, self.codes = np.zeros(self.places, np.uint64), np.zeros(self.places, np.int32)
            self._put(kept, codes)
        self._put(hashes, np.arange(self.n, end))
        self.n, self.filled = end, filled

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after another, and how many stand before each of them and in all."""
        size = self.size.take(codes)
        ends = np.cumsum(np.append(0, size))
        return self.ids.take(np.arange(ends[-1]) + np.repeat(self.begin.take(codes) - ends[:-1], size)), ends

    def _plain(self, low: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of a lowered text, and how many of them stand before each of some places."""
        start, end = _pre_tokens(low)
        hashes = slices(prefix_sums(_BYTE[low]), start, end) | np.uint64(1)  # 0 is a free place
        at, held = self._find(hashes)
        codes = self.codes.take(at).astype(np.int64)
        if held.all():
            self.again[codes] = True
        else:
            self.again[codes[held]] = True
            missing = np.flatnonzero(~held)
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            codes[missing] = self.n + which
            places, text = missing[first], low.tobytes()
            self._learn(new, [text[a:b] for a, b in zip(start[places].tolist(), end[places].tolist(), strict=True)])
        ids, ends = self._ids(codes)
        return ids, ends[np.searchsorted(start, begins)].tolist()

    def _other(self, text: str) -> np.ndarray:
        strings = [s for s in _ASCII_SPACE.split(text) if s]
        for s in strings:
            if s not in self.known:
                self.known[s] = np.array(self.library.encode(s, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *(self.known[s] for s in strings)])

    def __call__(self, text: bytes) -> Iterator[np.ndarray]:
        """The ids, in runs."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + SPAN) if len(text) > at + SPAN else None
            to = cut.start() if cut else len(text)
            low = _lowered(text[at:to])
            yield self._other(text[at:to].decode()) if low is None else self._plain(low, np.zeros(0, np.int64))[0]
            self._bounded()
            at = to

    def _bounded(self) -> None:
        """Forget the strings that were not met again since the last time, if there are too many."""
        if self.n + len(self.known) > STRINGS:
            kept = np.flatnonzero(self.again[: self.n])[: STRINGS // 2]
            (ids, _), sizes, hashes = self._ids(kept), self.size.take(kept), np.zeros(self.n, np.uint64)
            taken = np.flatnonzero(self.hashes)
            hashes[self.codes.take(taken)] = self.hashes.take(taken)
            self.forget()
            self._add(hashes.take(kept), sizes, ids)

    def each(self, texts: Iterable[bytes]) -> Iterator[Iterable[np.ndarray]]:
        """For one text after another its ids, in runs. Short texts are tokenised together, with white space between them, which no token reaches over."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            if group and size + len(text) > TOGETHER:
                yield from self._together(group)
                group, size = [], 0
            group.append(text)
            size += len(text) + 1
        yield from self._together(group)

    def _together(self, texts: list[bytes]) -> Iterator[Iterable[np.ndarray]]:
        low = _lowered(b"\n".join(texts)) if len(texts) > 1 else None
        if low is None:
            yield from map(self, texts)
            return
        ends = np.cumsum([len(t) + 1 for t in texts])
        ids, upto = self._plain(low, ends)
        self._bounded()
        for a, b in zip([0, *upto], upto, strict=False):
            yield (ids[a:b],)


def _stand_ins() -> dict[int, str]:
    """The printable letter for each byte in such vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TOKENIZERS: dict[str, RememberingTokenizer] = {}


def _tokenizer(path: str) -> RememberingTokenizer:
    """One a worker, kept from task to task with what it remembers."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = RememberingTokenizer(path)
    return _TOKENIZERS[path]


def _written(ids: np.ndarray, alphabet: np.ndarray, words: np.ndarray, pieces: list[tuple]) -> bytes:
    """A block's bytes."""
    gaps = np.diff(alphabet.astype(np.int64), prepend=-1) - 1
    more = gaps // 255
    spelled = np.full(int(more.sum()) + len(gaps), 255, np.uint8)
    spelled[np.cumsum(more + 1) - 1] = gaps % 255
    head = np.zeros(1, _HEAD)
    body = np.array(pieces, _PIECE).tobytes() + spelled.tobytes() + words.astype("<u4").tobytes()
    head[0] = (MAGIC, 0, zlib.crc32(ids.astype("<u4").tobytes()), len(ids), len(pieces), len(spelled), len(words))
    data = head.tobytes()[_AFTER_CRC:] + body
    head["crc"] = zlib.crc32(data)
    return head.tobytes()[:_AFTER_CRC] + data


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, pieces, alphabet, words) of a block whose checksum holds."""
    if len(data) < _HEAD.itemsize:
        raise ValueError("a block of token ids is cut off")
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != MAGIC or zlib.crc32(memoryview(data)[_AFTER_CRC:]) != head["crc"]:
        raise ValueError("a block of token ids does not have its checksum")
    at = _HEAD.itemsize
    pieces = np.frombuffer(data, _PIECE, head["pieces"], at)
    at += pieces.nbytes
    spelled = np.frombuffer(data, np.uint8, head["alphabet"], at)
    sums = np.cumsum(spelled.astype(np.int64))[spelled < 255]
    return head, pieces, sums + np.arange(len(sums)), np.frombuffer(data, "<u4", head["words"], at + spelled.nbytes)


BLOCKS = "part int, block long, first_id long, n_ids int, data binary"


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write the ids of docs (doc_id, text), in ascending order of doc_id (null first, ties by the texts' hash), as files in the folder `path`.

    A document is the ids of its text and then end_id; a null or empty text is end_id alone. Repeated rows are documents of their own, other
    columns are left out, an empty table makes an empty folder. Texts are dealt by ranges of doc_id, each range is one file, and a task holds a
    wave of blocks besides the text it reads, however long. tokenizer_path is read where a task runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        full: list[tuple[np.ndarray, list[tuple]]] = []
        runs: list[np.ndarray] = []
        pieces: list[tuple] = []
        room, ordinal, written, number = BLOCK, 0, 0, 0

        def close() -> None:
            nonlocal runs, pieces, room
            if runs:
                full.append((np.concatenate(runs), pieces))
            runs, pieces, room = [], [], BLOCK

        def wave() -> pa.RecordBatch:
            nonlocal full, written, number
            rows = []
            for (ids, own), (alphabet, words) in zip(full, encoded([ids for ids, _ in full]), strict=True):
                rows.append((part, number, written, len(ids), _written(ids, alphabet, words, own)))
                number, written = number + 1, written + len(ids)
            full = []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "block", "first_id", "n_ids", "data"])

        begin = 0
        for batch in batches:
            texts = (text.as_buffer().to_pybytes() if text.is_valid else b"" for text in batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), tokenizer.each(texts), strict=True):
                first = 0

                def add(ids: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
                    """Deal a run of the document's ids to blocks; a document has one piece a block."""
                    nonlocal room, first
                    at = 0
                    while at < len(ids):
                        if not room:
                            close()
                            if len(full) == WAVE:
                                yield wave()
                        n = min(room, len(ids) - at)
                        ended = last and at + n == len(ids)
                        if pieces and pieces[-1][2] == ordinal:
                            pieces[-1] = (*pieces[-1][:5], pieces[-1][5] + n, ended)
                        else:
                            pieces.append((doc is not None, doc or 0, ordinal, begin, first, n, ended))
                        runs.append(ids[at : at + n])
                        room, first, at = room - n, first + n, at + n

                for ids in found:
                    yield from add(ids, False)
                yield from add(np.array([end_id], np.uint32), True)
                begin, ordinal = begin + first, ordinal + 1
        close()
        if full:
            yield wave()

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(thrifty(run), BLOCKS).write.option("compression", "none").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What the blocks in the folder hold: (part, ordinal, doc_id, begin, first, length, last, crc32[, ids]), one row for each document in a block.

    ordinal and begin number the documents, and the ids before them, inside a part; first counts a document's ids before the piece.
    A block that isn't as it was written ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def wave() -> pa.RecordBatch:
            nonlocal held
            found, crcs, texts = [], [], []
            for (part, head, pieces, _, _), ids in zip(held, decoded([(h[3], h[4], int(h[1]["ids"])) for h in held]), strict=True):
                data = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(data) != head["ids_crc"]:
                    raise ValueError("a block of token ids does not give back what was written")
                ends = np.cumsum(pieces["length"], dtype=np.int64)
                found.append((np.full(len(pieces), part, np.int32), pieces))
                crcs += [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), pieces["length"].tolist(), strict=True)]
                if with_ids:
                    texts.append(ids.astype(np.int32))
            held = []
            rows = np.concatenate([p for _, p in found])
            columns = {
                "part": pa.array(np.concatenate([p for p, _ in found])),
                "ordinal": pa.array(rows["ordinal"].astype(np.int64)),
                "doc_id": pa.array(rows["doc_id"].astype(np.int64), mask=rows["known"] == 0),
                "begin": pa.array(rows["begin"].astype(np.int64)),
                "first": pa.array(rows["first"].astype(np.int64)),
                "length": pa.array(rows["length"].astype(np.int64)),
                "last": pa.array(rows["last"] == 1),
                "crc32": pa.array(crcs, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *rows["length"].tolist()], dtype=np.int32)), pa.array(np.concatenate(texts)))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head, pieces, alphabet, words = _opened(data.as_buffer().to_pybytes())
                held.append((part, head, pieces, alphabet, words))
                if len(held) == WAVE:
                    yield wave()
        if held:
            yield wave()

    limit_batches(spark)
    schema = "part int, ordinal long, doc_id long, begin long, first long, length long, last boolean, crc32 long" + ", ids array<int>" * with_ids
    return blocks(spark, path).select("part", "data").mapInArrow(thrifty(run), schema)


#: The polynomial of crc32, bits reversed: a fixed value.
_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), modulo crc32's; the highest bit is the constant term."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 13)
def _power(size: int) -> int:
    """x to the bits of so many bytes. Sizes of pieces are few, as a block has few ids."""
    bits, power, square = 8 * size, 1 << 31, 1 << 30
    while bits:
        if bits & 1:
            power = _product(power, square)
        square, bits = _product(square, square), bits >> 1
    return power


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """The crc32 of byte strings one after another, from each one's crc32 and size: what comes before is multiplied by x to its followers' bits."""
    out = 0
    for crc, size in zip(crcs, sizes, strict=True):
        out = _product(out, _power(size)) ^ crc
    return out


def _crc_of_pieces(pieces: pd.Series) -> pd.Series:
    """The crc32 of each document of several pieces (null for others), which have to follow one another up to the last one."""

    def one(rows) -> int | None:
        if rows is None:
            return None
        ends = [r["first"] + r["length"] for r in rows]
        if [r["first"] for r in rows] != [0, *ends[:-1]] or [r["last"] for r in rows] != [False] * (len(rows) - 1) + [True]:
            raise ValueError("blocks of a document are missing or repeated")
        return joined_crc([r["crc32"] for r in rows], [4 * r["length"] for r in rows])

    return pieces.map(one, na_action="ignore").astype("Int64")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the folder; start: the ids of all documents before it."""
    piece = F.struct("first", "length", "crc32", "last")
    documents = read_pieces(spark, path).groupBy("part", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.max("begin").alias("begin"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    only = F.get("pieces", F.lit(0))
    several = F.when((F.size("pieces") > 1) | (only["first"] > 0) | ~only["last"], F.col("pieces"))
    crc = F.coalesce(F.pandas_udf(_crc_of_pieces, "long")(several), only["crc32"])
    sizes = blocks(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return documents.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to a new folder of files and read back from them."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(), 1)
    return read_documents(spark, path)
