"""Base spans of the scans by plain regular expressions, and line dedup by all pairs, over a whole table: every column that the queries derive from them."""

import hashlib
import re

import pytest
from oracle import SMALL
from plain import brute_force

from evigrid.llm import line_dedup, pii, secrets_scan

LARGER = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def secrets(text):
    yield from ((m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    yield from ((m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20)
    yield from ((m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24)


def personal(text):
    yield from ((m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text))
    yield from ((m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".")))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), 2, "card", m.end()
    yield from ((m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)


@pytest.mark.parametrize(("query", "plain", "kinds"), [(secrets_scan.op8_secret_scan, secrets, ("assign", "access", "hex")), (pii.op9_personal_data, personal, ("email", "ip", "card", "phone"))])
def test_base_spans(spark, query, plain, kinds):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows, seen = query(spark, LARGER).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(plain(texts[r["doc_id"]]))
        named = [f"{kind}:{start}:{end}" for start, _, kind, end in base]
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[2] == k for b in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        starts = [int(s.split(":")[1]) for s in spans]
        assert set(named) <= set(spans) and starts == sorted(starts)
        seen += len(base)
    assert seen > 0


def test_line_dedup_whole_table(spark):
    """All lines of a table against all others: those that go are those that have an equal or near earlier line."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = brute_force(list(texts.items()))
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert {d: got.get(d) for d in want if (want[d] or "").strip()} == {d: t for d, t in want.items() if (t or "").strip()}
    assert gone
