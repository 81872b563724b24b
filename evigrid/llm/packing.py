"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

A bitset over sums (one Python integer) says which fillings can be reached with the lengths that remain; the largest is
taken and its counts are read back, length by length. What no multiset fills is filled by cutting one more piece,
and the last few pieces of a batch go to sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import limit_batches, table, thrifty

CAPACITY = 1024
#: Pieces shorter than a window that are packed together: bounds a task's memory. Not a cap: each batch is packed whole.
BATCH = 4096


class Tokenizer:
    """Ids of a byte-level BPE given as the JSON file of the tokenizers library.

    Its vocabulary is run by tiktoken, which gives the same ids some four times as fast; a text that it refuses goes to
    the file's own library. Strings of special tokens inside a text become their ids, as with that library's defaults.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        spec = json.loads(_read(path))
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        letters = _letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.own = path, None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except Exception:  # the pattern's stack on a pathological text
            if self.own is None:
                import tokenizers

                self.own = tokenizers.Tokenizer.from_file(self.path)
            return self.own.encode(text, add_special_tokens=False).ids


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _letters() -> dict[str, int]:
    """The usual printable stand-ins of byte-level BPE: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The sub-multiset of counts (length to number) with the largest sum up to capacity; longer lengths are tried first.

    reach[i] has bit s set when the first i lengths can sum to s. Numbers of a length are added in binary portions,
    so a length costs as many shifts as its number has digits.
    """
    full = (1 << (capacity + 1)) - 1
    lengths = sorted((x for x in counts if 0 < x <= capacity and counts[x]), reverse=True)
    reach, layers = 1, []
    for x in lengths:
        most, portion = min(counts[x], capacity // x), 1
        before = reach
        while most:
            take = min(portion, most)
            reach |= (reach << (take * x)) & full
            most -= take
            portion *= 2
        layers.append((x, before))
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for x, before in reversed(layers):
        n = 0
        while not (before >> total) & 1:
            total -= x
            n += 1
        if n:
            taken[x] = n
    return taken


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences for items of the given lengths: lists of (item, start inside the item, length).

    Every sequence sums to capacity, or to a power of two. Each unit of each item is used once.
    """
    stacks: dict[int, list[tuple[int, int]]] = {}
    left = 0
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append((i, 0))
        left += n
    stacks.pop(0, None)
    out: list[list[tuple[int, int, int]]] = []

    def draw(n: int, upto: int) -> tuple[int, int, int]:
        """Take `upto` units of an item of n; the rest goes back."""
        item, start = stacks[n].pop()
        if not stacks[n]:
            del stacks[n]
        if upto < n:
            stacks.setdefault(n - upto, []).append((item, start + upto))
        return item, start, upto

    while left:
        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        for n, times in best_filling({n: len(s) for n, s in stacks.items()}, room).items():
            for _ in range(times):
                sequence.append(draw(n, n))
                room -= n
        while room:  # no multiset fills the window: cut the longest that remains
            n = max(stacks)
            sequence.append(draw(n, min(n, room)))
            room -= sequence[-1][2]
        out.append(sequence)
    return out


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all rows of docs (doc_id, text).

    A document is the ids of its text and then id 0, so a null or empty text is the one id 0. Full windows of a document
    are sequences of their own; remainders are packed, batch by batch, inside the task that tokenises them: nothing is
    shuffled, and a task that is lost is simply done again, with the same sequence_ids (partition number and a counter).
    tokenizer_path is read where a task runs. A null doc_id stays null; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = Tokenizer(tokenizer_path)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rest: list[tuple[int | None, int, np.ndarray, int]] = []
        rows: list[tuple] = []

        def piece(doc: int | None, start: int, ids: np.ndarray, total: int, at: int) -> None:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, ids if with_ids else None))

        def flush() -> None:
            nonlocal sequence, rest
            for one in pack([len(x[2]) for x in rest], capacity):
                at = 0
                for i, start, n in one:
                    doc, first, ids, total = rest[i]
                    piece(doc, first + start, ids[start : start + n], total, at)
                    at += n
                sequence += 1
            rest = []

        def emit() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) or [()] * 8
            rows = []
            arrays = [pa.array(list(c), pa.int64()) for c in columns[:7]]
            if with_ids:
                ends = np.cumsum([0, *map(len, columns[7])], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *columns[7]]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*tokenizer(text.as_py() or ""), 0], "<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    piece(doc, start, ids[start : start + capacity], len(ids), 0)
                    sequence += 1
                if whole < len(ids):
                    rest.append((doc, whole, ids[whole:], len(ids)))
                if len(rest) >= BATCH:
                    flush()
                if len(rows) >= 4000:
                    yield emit()
        flush()
        yield emit()

    limit_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in sequences of up to 1024 ids."""
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
