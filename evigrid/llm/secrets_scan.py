"""Secret scans: fixed patterns, and formats learnt from labelled credentials by grammar inference.

Labelled credentials form a prefix tree over adaptive symbols: a character that dominates its place is itself, others are a
class. States are merged, most frequent ones first, where Hoeffding's bound sees no difference and there is evidence enough
to see one (ALERGIA, Carrasco and Oncina, 1994). The probabilistic automaton scores every other token by its likelihood against
a Markov chain of ordinary tokens, which is counted over the whole corpus.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import checkpointed, table, thrifty
from evigrid.llm.spans import Span, digested, in_order, overlaps, span_table

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Labelled credentials that an automaton is inferred from, at most, chosen by their hashes: a documented bound.
SAMPLE = 600
#: Significance of the merging test, and the occurrences of a state from which on it can be told from others.
ALPHA, EVIDENCE = 0.05, 12
#: Part of a place's characters from which on one is a symbol of its own.
DOMINANT = 0.5
#: Mean log likelihood ratio, a character, that a token needs at least, whatever the labelled ones reach.
LEAST_SCORE = 0.3

_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = re.compile(rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_BYTES = bytes(104 if 48 <= i <= 57 or 97 <= i <= 102 else 32 for i in range(256))
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Nested classes of characters, smallest first; a place takes the first that holds all its characters.
CLASSES = {"digits": _DIGITS, "hex": _DIGITS + _LOWER[:6], "HEX": _DIGITS + _UPPER[:6], "lower": _LOWER, "upper": _UPPER, "lower, digits": _DIGITS + _LOWER, "upper, digits": _DIGITS + _UPPER, "letters": _LOWER + _UPPER, "letters, digits": _DIGITS + _LOWER + _UPPER, "any": _DIGITS + _LOWER + _UPPER + "+/_.=-"}
_HELD = {name: frozenset(cs) for name, cs in CLASSES.items()}
#: Kinds of characters of ordinary tokens: their names and numbers of characters; "^" and "$" are a token's ends.
_PLAIN = {**dict.fromkeys(_DIGITS, "d"), **dict.fromkeys(_LOWER, "l"), **dict.fromkeys(_UPPER, "U"), **dict.fromkeys("+/_.=-", "s")}
_SIZE = {"d": 10, "l": 26, "U": 26, "s": 6, "$": 1}


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind; failing ones are dropped and not tried again."""
    out: list[Span] = []
    low = text.lower()
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return in_order(out, KINDS)


def _class_of(characters: set[str], least: str | None = None) -> str:
    """The first class that holds all the characters; of the classes from `least` on if few strings speak for a smaller one."""
    names = list(CLASSES)
    for name in names[names.index(least) if least else 0 :]:
        if characters <= _HELD[name]:
            return name
    return "any"


class Automaton:
    """A probabilistic automaton inferred from labelled strings: states with counts, transitions by symbol, and ends."""

    def __init__(self, strings: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = []
        self.n: list[int] = []
        self.end: list[int] = []
        self.on: list[dict[str, int]] = []
        self._whole = _class_of(set("".join(strings)) & _HELD["any"])
        self._tree(strings)
        self._merge(alpha)

    def _state(self) -> int:
        self.next.append({})
        self.n.append(0)
        self.end.append(0)
        self.on.append({})
        return len(self.n) - 1

    def _tree(self, strings: list[str]) -> None:
        """The prefix tree. At each place a dominant character is a symbol, the others are the smallest class that holds them.

        Where fewer than EVIDENCE strings are left, their rests are one looping state: any number of characters of one class.
        """
        self.tails: set[int] = set()
        waiting = [(self._state(), strings, 0)]
        while waiting:
            state, own, at = waiting.pop()
            rest = [s for s in own if len(s) > at]
            if state and len(own) < EVIDENCE:
                signs = sum(len(s) - at for s in rest)
                self.n[state], self.end[state] = signs + len(own), len(own)
                if signs:
                    self.on[state][self._whole], self.next[state][self._whole] = signs, state
                self.tails.add(state)
                continue
            self.n[state], self.end[state] = len(own), len(own) - len(rest)
            counts = Counter(s[at] for s in rest)
            literal = {c for c, k in counts.items() if k >= DOMINANT * len(own) and k >= EVIDENCE}
            others = set(counts) - literal
            name = _class_of(others, None if sum(counts[c] for c in others) >= EVIDENCE else self._whole) if others else None
            groups: dict[str, list[str]] = {}
            for s in rest:
                groups.setdefault(s[at] if s[at] in literal else name, []).append(s)
            for symbol, part in groups.items():
                self.on[state][symbol] = len(part)
                self.next[state][symbol] = child = self._state()
                waiting.append((child, part, at + 1))

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """No statistically visible difference between the two states and what follows them. Without evidence nothing is visible."""
        queue = deque([(a, b)])
        while queue:
            x, y = queue.popleft()
            n, m = self.n[x], self.n[y]
            if n < EVIDENCE or m < EVIDENCE or {x, y} & self.tails:
                continue
            far = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[x] / n - self.end[y] / m) > far:
                return False
            for c in self.on[x].keys() | self.on[y].keys():
                if abs(self.on[x].get(c, 0) / n - self.on[y].get(c, 0) / m) > far:
                    return False
                if c in self.next[x] and c in self.next[y]:
                    queue.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        queue = deque([(a, b)])
        while queue:
            x, y = queue.popleft()
            self.n[x] += self.n[y]
            self.end[x] += self.end[y]
            for c, k in self.on[y].items():
                self.on[x][c] = self.on[x].get(c, 0) + k
            for c, child in self.next[y].items():
                if c in self.next[x]:
                    if child not in self.tails:
                        queue.append((self.next[x][c], child))
                else:
                    self.next[x][c] = child

    def _merge(self, alpha: float) -> None:
        """Red states stay. Of the states just outside the most frequent is taken: it folds into the first red one it is like, or is red.

        A state with too little evidence to be told from any other is not taken for equal to all: it stays.
        """
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, known, outside, order = [0], {0}, [], 0

        def look(state: int) -> None:
            nonlocal order
            for c in sorted(self.next[state]):
                if (child := self.next[state][c]) not in known:
                    heapq.heappush(outside, (-self.n[child], order, state, c))
                    order += 1

        look(0)
        while outside:
            _, _, state, c = heapq.heappop(outside)
            blue = self.next[state][c]
            if blue in known:
                continue
            same = next((r for r in red if self._alike(r, blue, bound)), None) if self.n[blue] >= EVIDENCE and blue not in self.tails else None
            if same is None:
                red.append(blue)
                known.add(blue)
                look(blue)
            else:
                self.next[state][c] = same
                self._fold(same, blue)
                look(same)
        self.states = len(red)

    def shortest(self) -> int:
        """Characters of the shortest string of the grammar."""
        seen, now, n = {0}, [0], 0
        while not any(self.end[s] for s in now):
            now = list({t for s in now for t in self.next[s].values()} - seen)
            seen.update(now)
            n += 1
        return n

    def log_likelihood(self, token: str) -> float:
        """Log probability of the token, its end included; -inf off the grammar."""
        state, total = 0, 0.0
        for c in token:
            moves = self.next[state]
            if c in moves:
                total += math.log(self.on[state][c] / self.n[state])
                state = moves[c]
                continue
            name = next((x for x in moves if len(x) > 1 and c in _HELD[x]), None)
            if name is None:
                return -math.inf
            total += math.log(self.on[state][name] / self.n[state] / len(CLASSES[name]))
            state = moves[name]
        return total + math.log(self.end[state] / self.n[state]) if self.end[state] else -math.inf


class Ordinary:
    """Tokens of the corpus apart from base matches: a Markov chain over kinds of characters, from counted pairs of kinds."""

    def __init__(self, pairs: dict[str, int]) -> None:
        sums = Counter()
        for p, n in pairs.items():
            sums[p[0]] += n
        self.logs = {a + b: math.log((pairs.get(a + b, 0) + 1) / (sums[a] + 5) / _SIZE[b]) for a in "^dlUs" for b in "dlUs$"}

    def log_likelihood(self, token: str) -> float:
        kinds = ["^", *(_PLAIN[c] for c in token), "$"]
        return sum(self.logs[a + b] for a, b in zip(kinds[:-1], kinds[1:], strict=True))


class Formats:
    """An automaton for each labelled kind, and the score from which on a token counts: what 49 of 50 held-out labelled ones reach.

    One in four labelled credentials is held out for that. A kind with fewer than EVIDENCE of them has nothing to infer from.
    """

    def __init__(self, labelled: list[tuple[str, str]], pairs: dict[str, int] | None = None) -> None:
        self.ordinary = Ordinary(pairs or {})
        self.rules: list[tuple[Automaton, float]] = []
        for kind in sorted({k for k, _ in labelled}):
            strings = sorted({s for k, s in labelled if k == kind})
            if len(strings) < EVIDENCE:
                continue
            automaton = Automaton([s for i, s in enumerate(strings) if i % 4])
            scores = sorted(x for s in strings[::4] if (x := self.score(automaton, s)) > -math.inf)
            if scores:
                self.rules.append((automaton, max(LEAST_SCORE, scores[len(scores) // 50])))
        self.shortest = min((automaton.shortest() for automaton, _ in self.rules), default=1)

    def score(self, automaton: Automaton, token: str) -> float:
        """Mean log likelihood ratio against ordinary tokens, a character; -inf off the grammar."""
        found = automaton.log_likelihood(token)
        return -math.inf if found == -math.inf else (found - self.ordinary.log_likelihood(token)) / max(1, len(token))

    def fits(self, token: str) -> bool:
        return any(self.score(automaton, token) >= least for automaton, least in self.rules)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Tokens apart from base spans whose format is likely. All are scored but those shorter than any string of the grammars, which have no likelihood."""
        if not self.rules:
            return []
        return [(ADDED, a, b) for a, b, token in tokens(text, self.shortest) if not overlaps(a, b, base) and self.fits(token)]


def tokens(text: str, shortest: int = 1) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters with "=" at their end only, and without points there; those of so many characters at least."""
    for m in _runs(shortest).finditer(text):
        token = m[0].rstrip(".")
        if len(token) >= shortest:
            yield m.start(), m.start() + len(token), token


@cache
def _runs(shortest: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{max(1, shortest - 2)},}}={{0,2}}")


def _is_labelled(kind: str, text: str, a: int, b: int) -> str:
    return _ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]


def _gathered(docs: DataFrame) -> DataFrame:
    """(kind, secret, n): distinct labelled credentials, and the counted pairs of kinds of all other tokens (kind "pair")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                found.update((kind, _is_labelled(kind, text, a, b)) for kind, a, b in base)
                at = 0
                for _, a, b in [*sorted(base, key=lambda s: s[1]), ("", len(text), len(text))]:
                    if a > at:
                        _count(text[at:a], pairs)
                    at = max(at, b)
            yield _rows([(k, s, 1) for k, s in found])
        yield _rows([("pair", p, n) for p, n in pairs.items()])

    return docs.select("text").mapInArrow(thrifty(run), "kind string, secret string, n long").groupBy("kind", "secret").agg(F.sum("n").alias("n"))


_KIND_BYTES = bytes(ord(_PLAIN.get(chr(i), " ")) for i in range(256))


def _count(text: str, pairs: Counter) -> None:
    """Add the pairs of kinds of the text's tokens, vectorised over its bytes; a character outside ASCII ends a token."""
    import numpy as np

    kinds = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass").translate(_KIND_BYTES), np.uint8)
    codes = np.searchsorted(_ORDER, kinds)
    counts = np.bincount(codes[:-1] * 5 + codes[1:], minlength=25)
    for i in np.flatnonzero(counts):
        a, b = _NAMES[i // 5], _NAMES[i % 5]
        if a != " " or b != " ":
            pairs[("^" if a == " " else a) + ("$" if b == " " else b)] += int(counts[i])


_NAMES = " Udls"
_ORDER = [ord(c) for c in _NAMES]


def _rows(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    kinds, secrets_, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(secrets_, pa.string()), pa.array(n, pa.int64())], ["kind", "secret", "n"])


def learnt(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from the documents' own base matches, those with the smallest hashes, `sample` for each kind at most, and from all their other tokens."""
    rows = checkpointed(_gathered(docs).withColumn("h", F.xxhash64("secret")))
    labelled: list[tuple[str, str]] = []
    for kind in KINDS:  # three bounded reports
        labelled += [(r["kind"], r["secret"]) for r in rows.where(F.col("kind") == kind).orderBy("h", "secret").limit(sample).collect()]
    return Formats(labelled, {r["secret"]: r["n"] for r in rows.where("kind = 'pair'").limit(25).collect()})  # 25 pairs of kinds


def secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text): spans of base matches and of tokens in a labelled format.

    Positions are code points of the whole text, ends exclusive. Null or empty text: no spans. Without labelled credentials only base
    matches are found. Rows are scanned one by one; repeated rows give repeated rows. Other columns are ignored.
    """
    given = docs.sparkSession.sparkContext.broadcast(formats)

    def scanner():
        def scan(text: str) -> tuple[list[Span], list[Span]]:
            base = base_spans(text)
            return base, given.value.spans(text, base)

        return scan

    return span_table(docs, scanner)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; formats are learnt from their own base matches."""
    docs = table(spark, sf_dir, "documents")
    return digested(secrets(docs, learnt(docs)), KINDS, ADDED)
