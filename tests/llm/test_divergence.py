"""Source divergence against a plain version; its SQL runs in test_operators."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from evigrid.llm import divergence

DOC = "text string, lang string, source string, value int, n int, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, ranks):
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {x[1] for x in found}:
        own = [(t, s) for t, x, s in found if x == lang]
        in_docs = Counter(w for t, _ in own for w in set(t))
        kept = [w for w, n in in_docs.items() if n >= least]
        counts = {s: Counter() for _, s in own}
        for t, s in own:
            counts[s].update(w for w in t if in_docs[w] >= least)
        total = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        parts = defaultdict(list)
        for s, c in counts.items():
            parts[s, "pair"] = [(-sum(abs(p(c, w) - p(d, w)) for w in kept), x.encode(), x) for x, d in counts.items() if x != s]
            parts[s, "term"] = [(p(total, w) - p(c, w), w.encode(), w) for w in kept if c[w] and p(c, w) > p(total, w)]
        out += [(lang, s, part, item, -v, r) for (s, part), rows in parts.items() for r, (v, _, item) in enumerate(sorted(rows), 1) if part == "pair" or r <= ranks]
    return sorted(out)


def rows(df, **how):
    return sorted(map(tuple, divergence.divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("cells", [divergence.CELLS, 3])
def test_cases(spark, monkeypatch, cells):
    """Nulls, empty texts, groups without terms, a language without kept terms, ties, non-ASCII letters, repeated rows, clashing columns."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    if cells == 3:
        monkeypatch.setattr(divergence, "HELD", 5)
        monkeypatch.setattr(divergence, "SPAN", 50)
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "beta", "élan", "ÉLAN", "日本", "x_y", "don't", "gamma1delta", "İ", "zeta", "ab", "aB"]
    docs = [(" ".join(rng.choice(vocabulary, rng.integers(0, 40))), ["en", "de"][i % 2], f"s{rng.integers(0, 6)}") for i in range(120)]
    docs += docs[:5] + [(None, "en", "s0"), ("alpha", None, None), ("", "fr", "a"), ("rare words", "fr", "b"), ("...", "fr", "c"), (None, "en", "only"), ("word " * 20_000, "en", "s1")]
    df = spark.createDataFrame([(*d, 1, 2, "t") for d in docs], DOC).repartition(3)
    for least, ranks in ((3, 4), (30, 50), (1000, 5)):
        assert rows(df, least=least, ranks=ranks) == plain(docs, least, ranks)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    for least in (divergence.LEAST, 3):
        assert rows(df, least=least) == plain(docs, least, divergence.RANKS)


def test_empty_table(spark):
    assert rows(spark.createDataFrame([], DOC)) == []


def test_share_of_large_counts(spark):
    """Exact where 64-bit arithmetic would not be."""
    count, total, v = 9 * 10**17 + 1, 10**18, 10**6
    got = spark.range(1).select(divergence._share(F.lit(count), F.lit(total), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * v)
