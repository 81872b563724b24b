"""The two scanning operators over whole tables: base matches and added spans against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F

from evigrid.llm import pii, secrets_scan

DOC = "doc_id long, text string, spans string"  # a column that clashes with one of the result
ALNUM = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


def keys(n, seed=2):
    rng = np.random.default_rng(seed)
    return ["ghp_" + "".join(rng.choice(ALNUM, 20)) for _ in range(n)]


def secret_fixture(spark):
    own = keys(60)
    rows = [(i, f"set secret={k} and go", "x") for i, k in enumerate(own[:40])]
    rows += [(100 + i, f"some text {k}. {k}", "x") for i, k in enumerate(own[40:])]
    rows += [(200, "ghp_internationalizations ghp_abc " + "word" * 40000, "x"), (201, None, "x"), (202, "", None), (None, own[41], "x"), (100, f"some text {own[40]}. {own[40]}", "x")]
    return spark.createDataFrame(rows, DOC)


def test_masked_credentials(spark):
    """Bare keys in a labelled format are found, words are not; repeated rows, nulls, a very long text and a clashing column do no harm."""
    docs = secret_fixture(spark)
    formats = secrets_scan.learnt(docs)
    assert all(a.states > 1 for a, _ in formats.rules)
    got = defaultdict(list)
    for r in secrets_scan.secrets(docs, formats).collect():
        got[r["doc_id"]].append([(s["kind"], s["start"], s["end"]) for s in r["spans"]])
    bare = [x for d in range(100, 120) for x in got[d][0]]
    assert len(bare) >= 36 and all(k == "format" and b - a == 24 for k, a, b in bare) and got[None][0] == [("format", 0, 24)]
    assert len(got[100]) == 2 and got[100][0] == got[100][1] and got[200] == got[201] == got[202] == [[]]
    assert all([k for k, _, _ in got[i][0]] == ["assign"] for i in range(40))


def test_scores_by_brute_force(spark):
    """Every run of credential characters of the table, scored by walking the automaton's tables by hand."""
    docs = documents(spark).unionByName(secret_fixture(spark).select("doc_id", "text"))
    formats = secrets_scan.learnt(docs)

    def walk(a, token, state=0):
        if not token:
            return a.end[state] / a.n[state]
        for symbol, then in a.next[state].items():
            held = secrets_scan.CLASSES.get(symbol, symbol)
            if token[0] in held and not (len(symbol) > 1 and token[0] in a.next[state]):
                return a.on[state][symbol] / a.n[state] / len(held) * walk(a, token[1:], then)
        return 0.0

    def fits(token):
        if len(token) > 300:
            return False
        for a, least in formats.rules:
            if (p := walk(a, token)) and (math.log(p) - formats.ordinary.log_likelihood(token)) / len(token) >= least - 1e-12:
                return True
        return False

    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if not s["base"]} for r in secrets_scan.secrets(rows, formats).collect()}
    for d, text in rows.collect():
        base = [(a, b) for _, a, b in secrets_scan.base_spans(text or "")]
        runs = [(m.start(), m.start() + len(m[0].rstrip("."))) for m in re.finditer(r"[A-Za-z0-9+/_.-]+={0,2}", text or "")]
        assert got[d] == {(a, b) for a, b in runs if a < b and not any(a < y and x < b for x, y in base) and fits(text[a:b])}, d


def test_ordinary_pairs():
    """The vectorised counts of pairs of kinds are those of a plain loop over tokens."""
    text, got = "Ab1 +x- 99\u00e9Z=.. \n q", Counter()
    secrets_scan._count(text, got)
    want = Counter()
    for token in re.findall(r"[A-Za-z0-9+/_.=-]+", text):
        kinds = "^" + "".join(secrets_scan._PLAIN[c] for c in token) + "$"
        want.update(kinds[i : i + 2] for i in range(len(kinds) - 1))
    assert got == want


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= sum(c.isdigit() for c in t) <= 19 and pii.luhn("".join(c for c in t if c.isdigit()))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= sum(c.isdigit() for c in t) <= 15),
}


def pii_fixture(spark):
    rows = [(i, f"my number is +1 (555) 123-{4000 + i} thanks, call +1 (555) 123-{4000 + i} 190.137.223.204 now", "x") for i in range(20)]
    rows += [(30 + i, f"my number is CUSTOMER{i}{i} or a1b2c3d4e5{'f' * 80}{i}", "x") for i in range(3)] + [(99, "order 12-3456 " * 3000, "x"), (100, None, "x"), (101, "", None), (None, "my number is 7", "x"), (30, "my number is CUSTOMER00", "x")]
    return spark.createDataFrame(rows, DOC)


def test_personal_data_base(spark):
    """Base matches of the whole table are those of the plain patterns."""
    docs = documents(spark).unionByName(pii_fixture(spark).select("doc_id", "text"))
    for _, text in docs.collect():
        want = sorted((k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0]))
        assert sorted(pii.base_spans(text or "")) == want


def trusted(edges, rounds, support, least):
    """trusted_patterns, with dictionaries."""
    weight, names, patterns = {}, defaultdict(set), {}
    for p, i, known in edges:
        names[p].add(i)
        weight[p, i] = max(weight.get((p, i), 0.0), float(known))
    sure = {k for k, w in weight.items() if w == 1}
    for _ in range(rounds):
        found = {}
        for p, own in names.items():
            s, n, zz = sum(weight[p, i] for i in own), len(own), pii.Z**2
            share = s / n
            low = (share + zz / (2 * n) - pii.Z * math.sqrt(max(0.0, share * (1 - share) / n + zz / (4 * n * n)))) / (1 + zz / n)
            if s >= support and low >= least:
                found[p] = low
        same, patterns = set(found) == set(patterns), found
        if same or not found:
            break
        lent = {}
        for p, i in weight:
            if p in found and (p, i) not in sure:
                lent[i] = lent.get(i, 1.0) * (1.000001 - found[p])
        weight = {(p, i): 1.0 if (p, i) in sure else 1 - lent[i] if i in lent else 0.0 for p, i in weight}
    return patterns


def test_patterns_by_brute_force(spark):
    """Trusted patterns and their confidence over the whole table and the fixture; and what they find."""
    docs = documents(spark).unionByName(pii_fixture(spark).select("doc_id", "text"))
    edges = pii.occurrences(docs)
    got = {r["pattern"]: r["confidence"] for r in pii.trusted_patterns(edges, confidence=0.6).collect()}
    want = trusted([tuple(r) for r in edges.collect()], pii.ROUNDS, pii.SUPPORT, 0.6)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    fixture = pii_fixture(spark)
    found = defaultdict(list)
    for r in pii.personal_data(fixture, pii.trusted_patterns(pii.occurrences(fixture), confidence=0.6)).collect():
        found[r["doc_id"]].append([(s["start"], s["end"]) for s in r["spans"] if not s["base"]])
    text = {r["doc_id"]: r["text"] for r in fixture.collect()}
    for i in range(20):  # the phone that a known address follows is no base match: its digits run on
        assert any("+1 (555) 123" in text[i][a:b] for a, b in found[i][0])
    assert [text[31][a:b] for a, b in found[31][0]][:1] == ["CUSTOMER11"] and len(found[30]) == 2 and found[None][0] == [(13, 14)]
    assert found[99] == found[100] == found[101] == [[]]
