"""Fill-in-the-middle against a plain version, with marks, nulls and odd white space; its SQL runs in test_operators."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from evigrid.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc, len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def got(df):
    rows = infill.infilled(df).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in rows)
    return sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=str)


ODD = ["", None, " ", "\n\n", "a", " a", "a ", "  a  b  ", "<P>", "x <M y", "<<S", "<S", "P>", "é ü ß 😀😀 日本", "\t\x0b\x0c\r x", "a\x1cb c\x85d", "M>", "<", ">", "<P", "<S <P <M > a", "w " * 50_000]


def test_cases(spark):
    """Odd texts under many ids, so that each form and cut occurs; repeated rows, a null id, clashing columns."""
    docs = [(i, t) for i, t in enumerate(ODD * 12)] + [(None, "a b c d"), (7, "x y"), (7, "x y")]
    df = spark.createDataFrame([(d, t, "n", "o", 3) for d, t in docs], "doc_id long, text string, n string, output string, draws int")
    want = sorted((plain(d, t) for d, t in docs), key=str)
    assert got(df) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(df) == sorted((plain(r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_empty_table(spark):
    assert infill.infilled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_kernel_on_slices(seed):
    """Batches that begin inside a buffer give what each text gives alone."""
    rng = np.random.default_rng(seed)
    texts = pa.array(["".join(rng.choice(list("ab \n<>PSMé"), rng.integers(0, 30))) for _ in range(80)])
    draws = rng.integers(0, 1 << 32, (80, 4))
    whole = infill.cut(texts.slice(13), draws[13:])
    for i in range(13, 80):
        one = infill.cut(texts.slice(i, 1), draws[i : i + 1])
        assert all((whole[k][i - 13] == one[k][0]).all() for k in one)
