"""Personal data: fixed patterns, and identifiers found by their contexts and shapes.

Known entities (the base matches) lend weight to the lexical patterns around them; patterns that mostly go with known entities lend
weight to other identifiers; this goes on over the graph of patterns and instances until the trusted patterns stay the same.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import checkpointed, table, thrifty
from evigrid.llm.spans import Span, digested, in_order, span_table

KINDS = ("email", "ip", "card", "phone")
ADDED = "context"
#: Weight of distinct entities that a pattern needs, and the confidence (Wilson's lower bound, one-sided 95 %) from which on it is trusted.
SUPPORT, CONFIDENCE, Z = 4, 0.7, 1.645
#: Trusted patterns that go to the executors as a whole, at most; more of them meet the texts' own patterns by a join instead.
PATTERNS = 10_000
#: Rounds over the graph, at most; weights only grow, so that it settles before in practice.
ROUNDS = 10
#: Tokens of one identifier, at most: "+1 (555) 123-4567" has three.
PARTS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s=\"'<>,;|]+")
_WORDS = re.compile(r"[^\W\d_]+")
_DIGITS = frozenset("0123456789")
_DIGIT_BYTES = bytes(100 if 48 <= i <= 57 else 32 for i in range(256))
_RUNS = re.compile(r"9+|a+|A+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _emails(text: str) -> Iterator[Span]:
    """Each "@" belongs to one match at most, which begins where the run of local characters before it does, or the last match ends."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind; failing ones are dropped and not tried again."""
    out = list(_emails(text)) if "@" in text else []
    digits = text.encode("utf-8", "surrogatepass").translate(_DIGIT_BYTES)
    if b"d" in digits:
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return in_order(out, KINDS)


def shape(identifier: str) -> str:
    """Its characters with digits as 9, letters as a and A, and with runs of them counted; a digest where that is long."""
    flat = "".join("9" if c in _DIGITS else "A" if c.isupper() else "a" if c.isalpha() else c for c in identifier)
    out = _RUNS.sub(lambda m: f"{m[0][0]}{len(m[0])}" if len(m[0]) > 1 else m[0], flat)
    return out if len(out) <= 64 else hashlib.blake2b(out.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Candidates:
    """The identifiers that a text could hold, and the patterns around each place of it.

    A candidate is a token with a digit (a run without white space, quotes, brackets of tags, "=", ",", ";" and "|", without other
    signs than "+" and parentheses at its ends), or up to PARTS of them in a row with one space between, apart from known entities.
    """

    def __init__(self, text: str, known: list[Span]) -> None:
        self.text = text
        self.words = [(m.start(), m.end(), m[0].lower()) for m in _WORDS.finditer(text)]
        self.starts, self.ends = [w[0] for w in self.words], [w[1] for w in self.words]
        self.taken = sorted((a, b) for _, a, b in known)
        # the furthest end up to each known entity, for overlaps
        self.reach, far = [], 0
        for _, b in self.taken:
            far = max(far, b)
            self.reach.append(far)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_left(self.taken, (b, 0))
        return i > 0 and self.reach[i - 1] > a

    def places(self) -> Iterator[tuple[int, int]]:
        tokens = []
        for m in _TOKEN.finditer(self.text):
            if _DIGITS.isdisjoint(m[0]):
                continue
            a, b = m.span()
            while a < b and not (self.text[a].isalnum() or self.text[a] in "+("):
                a += 1
            while a < b and not (self.text[b - 1].isalnum() or self.text[b - 1] == ")"):
                b -= 1
            tokens.append((a, b))
        for i, (a, b) in enumerate(tokens):
            if not self.overlaps(a, b):
                yield a, b
            for x, y in tokens[i + 1 : i + PARTS]:
                if x != b + 1 or self.text[b] != " ":
                    break
                b = y
                if not self.overlaps(a, b):
                    yield a, b

    def patterns(self, a: int, b: int) -> list[str]:
        """Names of the patterns that hold at a place: its whole shape; and the words before and after, two on one side for any shape."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        before, after = [w[2] for w in self.words[max(0, i - 3) : i]], [w[2] for w in self.words[j : j + 2]]
        own = shape(self.text[a:b])
        kind = re.sub(r"(?<=[9aA])[0-9]+", "", own)
        out = [f"shape {own}"]
        if before:
            out.append(f"{before[-1]} _ {kind}")
        if after:
            out.append(f"_ {after[0]} {kind}")
        if before and after:
            out.append(f"{before[-1]} _ {after[0]}")
        if len(before) > 1:
            out.append(f"{before[-2]} {before[-1]} _")
        if len(before) > 2:
            out.append(f"{before[-3]} {before[-2]} * _")
        if len(after) > 1:
            out.append(f"_ {after[0]} {after[1]}")
        return out


def _instance(identifier: str) -> int:
    return int.from_bytes(hashlib.blake2b(identifier.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _has_digit(text: str) -> bool:
    return b"d" in text.encode("utf-8", "surrogatepass").translate(_DIGIT_BYTES)


def occurrences(docs: DataFrame) -> DataFrame:
    """(pattern, instance, known): the graph's edges, a batch's repeats once. instance is a 64-bit hash of the identifier's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int, bool]] = set()
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                if not base and not _has_digit(text):
                    continue
                own = Candidates(text, base)
                for a, b, known in [(a, b, True) for _, a, b in base] + [(a, b, False) for a, b in own.places()]:
                    found.update((p, _instance(text[a:b]), known) for p in own.patterns(a, b))
            rows = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(rows[0]), pa.string()), pa.array(list(rows[1]), pa.int64()), pa.array(list(rows[2]), pa.bool_())], ["pattern", "instance", "known"])

    return docs.select("text").mapInArrow(thrifty(run), "pattern string, instance long, known boolean")


def _lower_bound(share: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share seen in n trials."""
    zz = z * z
    return (share + zz / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), share * (1 - share) / n + zz / (4 * n * n)))) / (1 + zz / n)


def trusted_patterns(graph: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, confidence, support) of the patterns to be trusted, from edges (pattern, instance, known).

    Support is the summed weight of a pattern's distinct instances, its share that sum over their number, and its confidence Wilson's
    lower bound of the share, so that a pattern of few instances is not trusted for luck. A known instance weighs 1, another one minus
    the product of its trusted patterns' doubts. Weights and trusted patterns only grow; the rounds end when the patterns stay the same.
    Every round is a join and two aggregates over distinct edges, cut by a checkpoint. A pattern without a known instance
    of its own can be trusted from the second round on.
    """
    edges = checkpointed(graph.groupBy("pattern", "instance").agg(F.max("known").alias("known")))
    unknown = edges.where("NOT known")
    seen, patterns, weighed = None, None, edges.withColumn("weight", F.col("known").cast("double"))
    for _ in range(rounds):
        patterns = weighed.groupBy("pattern").agg(F.avg("weight").alias("share"), F.sum("weight").alias("support"), F.count("*").alias("n"))
        patterns = patterns.withColumn("confidence", _lower_bound(F.col("share"), F.col("n").cast("double"), Z))
        patterns = checkpointed(patterns.where((F.col("support") >= support) & (F.col("confidence") >= confidence)).select("pattern", "confidence", "support"))
        now = tuple(patterns.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        doubt = F.sum(F.log(F.lit(1.000001) - F.col("confidence")))
        lent = unknown.join(patterns, "pattern").groupBy("instance").agg((F.lit(1.0) - F.exp(doubt)).alias("lent"))
        weighed = edges.join(lent, "instance", "left").withColumn("weight", F.when(F.col("known"), 1.0).otherwise(F.coalesce("lent", F.lit(0.0))))
    return patterns


def personal_data(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text): base matches, and other identifiers where a trusted pattern holds.

    Of candidates that overlap the first one counts, of those with the same start the longest. Positions are code points of the whole
    text, ends exclusive. Null or empty text: no spans. Without trusted patterns only base matches are found. Rows are scanned one
    by one; repeated rows give repeated rows. Other columns are ignored.
    """
    rows = patterns.select("pattern").limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        return _joined(docs, patterns)
    trusted = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in rows))

    def scanner():
        known = trusted.value
        return lambda text: _scan(text, known)

    return span_table(docs, scanner)


def _scan(text: str, known: Collection[str]) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    if not known or not _has_digit(text):
        return base, []
    own = Candidates(text, base)
    held = frozenset(known)
    added: list[Span] = []
    for a, b in sorted(own.places(), key=lambda s: (s[0], -s[1])):
        if (not added or added[-1][2] <= a) and not held.isdisjoint(own.patterns(a, b)):
            added.append((ADDED, a, b))
    return base, added


def _joined(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """personal_data for any number of patterns: each text meets only its own trusted ones, found by a join on the pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(*batch.columns, strict=True):
                text = text.as_py() or ""
                candidates = Candidates(text, base_spans(text))
                own = {p for a, b in candidates.places() for p in candidates.patterns(a, b)}
                ids += [doc.as_py()] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["key", "pattern"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = rows.mapInArrow(thrifty(run), "key long, pattern string").join(patterns.select("pattern"), "pattern")
    own = held.groupBy("key").agg(F.collect_set("pattern").alias("trusted"))
    return span_table(rows.join(own, F.col("doc_id").eqNullSafe(F.col("key")), "left"), lambda: _scan, ("trusted",))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; patterns are learnt from their own base matches."""
    docs = table(spark, sf_dir, "documents")
    return digested(personal_data(docs, trusted_patterns(occurrences(docs))), KINDS, ADDED)
