"""Spans (kind, start, end) as columns, shared by the two scanning operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.common import thrifty

Span = tuple[str, int, int]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the kinds' order."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def overlaps(a: int, b: int, spans: list[Span]) -> bool:
    return any(a < y and x < b for _, x, y in spans)


def span_table(docs: DataFrame, scanner: Callable[[], Callable[..., tuple[list[Span], list[Span]]]], more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, spans) per row of docs (doc_id, text); scanner() makes, once a task, a function from a text, and the columns more, to its base and added spans."""
    kind = "array<struct<kind:string,start:long,end:long,base:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            out = []
            for text, *others in zip(*batch.columns[1:], strict=True):
                base, added = scan(text.as_py() or "", *(x.as_py() for x in others))
                out.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base] + [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in added])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(thrifty(run), f"doc_id long, spans {kind}")


def digested(spans: DataFrame, kinds: tuple[str, ...], added: str) -> DataFrame:
    """(doc_id, n_<kind> of the base spans, base_sha256, spans, n_spans of all of them) from span_table's rows."""
    every = (*kinds, added)

    def ordered(only_base: bool):
        rows = F.filter("spans", lambda x: x["base"]) if only_base else F.col("spans")
        keyed = F.transform(rows, lambda x: F.struct(x["start"].alias("s"), F.array_position(F.array(*(F.lit(k) for k in every)), x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
        return F.array_join(F.transform(F.sort_array(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def counted(kind: str):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in kinds]
    return spans.select("doc_id", *counts, F.sha2(ordered(True).cast("binary"), 256).alias("base_sha256"), ordered(False).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
