"""Token files: coder, block format, whole tables against the tokenizers library, damaged files."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SMALL
from pyspark.sql import functions as F

from evigrid.llm import context_coder, token_files

DOC = "doc_id long, text string, lang string, part int, ids string"
END = 1


def library(texts):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(token_files.tokenizer_path())
    return [[*e.ids, END] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    coded = context_coder.encoded(blocks)
    back = context_coder.decoded([(a, w, len(b)) for (a, w), b in zip(coded, blocks, strict=True)])
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]
    return coded


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49_407) | st.integers(0, 3), min_size=1, max_size=300), max_size=12))
def test_coder_gives_back_ids(blocks):
    check(blocks)


def test_coder_extremes():
    """Blocks of one id, of one id repeated, of all different ids, random ones, and a repeated passage, which orders 1 and 2 make short."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 40_000, 400)
    blocks = [[7], [49_407] * 2048, list(range(2048)), rng.integers(0, 49_408, 2048), np.tile(passage, 5), rng.integers(0, 2, 2047)]
    words = [len(w) for _, w in check(blocks)]
    assert words[1] < 10 and words[4] < words[3] / 2
    alone = context_coder.encoded([np.array(blocks[4], np.uint32)])[0]  # a block's bytes don't depend on its wave
    assert (alone[1] == context_coder.encoded([np.array(b, np.uint32) for b in blocks])[4][1]).all()
    assert context_coder.encoded([]) == [] and context_coder.decoded([]) == []


def test_joined_crc():
    parts = [b"", b"abc", bytes(range(256)) * 9, b"\0" * 5000]
    assert token_files.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_tokenizer_like_library():
    """Chunks between ASCII white space, special strings, other white space, combining letters, contractions, emptied memory."""
    texts = ["", " \n", "It's  o'clock\tDON'T", "a b\x1cc d\x85e", "x<|endoftext|>y <|startoftext|>", "é ́e ΣΑΣ Σ", "1234 $%&_ 日本語 😀", "İstanbul ﬁ", "a" * 5000, "Ünïcödé ÑANDÚ× ÷ ªº ÿŸ", "x_y[z]\\^`{|}~ 1st 2nd", "'S 'll'D", "<|x|> <|ENDOFTEXT|>", "ǅ ŉ ẞß", "we'll, 'tis ''s x's'd 3's can't've", "ä'sÖ", "plain ASCII only, isn't it?", "\xa0nbsp\xadsoft"]
    tokenizer = token_files.RememberingTokenizer(token_files.tokenizer_path())
    for text, want in zip(texts, library(texts), strict=True):
        runs = list(tokenizer(text.encode()))
        assert np.concatenate([*runs, [END]]).tolist() == want
        if len(text) > 20:
            tokenizer.forget()


def test_long_text_in_spans(monkeypatch):
    monkeypatch.setattr(token_files, "SPAN", 50)
    monkeypatch.setattr(token_files, "STRINGS", 7)
    text = " ".join(f"word{i % 13} x\n{i}" for i in range(200))
    assert np.concatenate([*token_files.RememberingTokenizer(token_files.tokenizer_path())(text.encode()), [END]]).tolist() == library([text])[0]


def test_short_texts_together(monkeypatch):
    """Short texts cost one step for many of them, and each has the ids it has alone: empty ones, contractions at borders, other alphabets, long texts between."""
    texts = ["it'", "s mine", "", "<", "|x|>", "won", "'t", "Ünï", " a ", "", "b\n", "12", "34"] * 3 + ["日本語", "x<|endoftext|>y", ""] + ["word " * 40] + ["don't", ""]
    calls, plain = [], token_files.RememberingTokenizer._plain
    monkeypatch.setattr(token_files.RememberingTokenizer, "_plain", lambda self, *a: calls.append(1) or plain(self, *a))
    for together, strings in ((100, 1 << 19), (1 << 16, 1 << 19), (30, 3), (0, 5)):
        monkeypatch.setattr(token_files, "TOGETHER", together)
        monkeypatch.setattr(token_files, "STRINGS", strings)
        tokenizer = token_files.RememberingTokenizer(token_files.tokenizer_path())
        assert [np.concatenate([*runs, [END]]).tolist() for runs in tokenizer.each(t.encode() for t in texts)] == library(texts)
        assert list(tokenizer.each([])) == []
    monkeypatch.undo()
    monkeypatch.setattr(token_files.RememberingTokenizer, "_plain", lambda self, *a: calls.append(1) or plain(self, *a))
    calls.clear()
    assert [np.concatenate([*r]).tolist() for r in tokenizer.each([b"ab c"] * 1000)] == [library(["ab c"])[0][:-1]] * 1000
    assert len(calls) == 1


def test_strings_met_again_stay(monkeypatch):
    """A full memory gives up what was met once only: the model gets a common word once, however many rare ones pass by, and ids stay right."""
    monkeypatch.setattr(token_files, "STRINGS", 40)
    tokenizer, asked = token_files.RememberingTokenizer(token_files.tokenizer_path()), []

    class Model:
        def tokenize(self, string, model=tokenizer.model):
            asked.append(string)
            return model.tokenize(string)

    tokenizer.model = Model()
    common = "evidence isn't whatever Ünïcödé says"
    texts = [f"{common} rare{'abcdefghij'[i % 10] * (i // 10 + 1)} {'xyz'[i % 3] * (i + 1)}" for i in range(90)]
    for text, want in zip(texts, library(texts), strict=True):
        assert np.concatenate([*tokenizer(text.encode()), [END]]).tolist() == want
    assert asked.count("evidence") == 1 and asked.count("whatever") == 1
    assert tokenizer.n < 60


@pytest.mark.parametrize("length", [1, 2, 15, 16, 17, 700, 2048])
def test_coder_masks(length):
    """Ids that order 1, order 2, both or neither name, at all confidences, in blocks of equal and different lengths."""
    rng = np.random.default_rng(length)
    tails = [np.where(rng.random(length) < p, np.arange(length) % k, rng.integers(0, 2048, length)) for p in (0, 0.5, 0.97, 1) for k in (1, 2, 3, 11, 400)]
    check([t[: rng.integers(1, length + 1)] for t in tails] + tails)


def want_rows(docs, ids):
    """Plain: documents in order, ids before each, checksums."""
    out, start = [], 0
    for (doc, _), own in zip(docs, ids, strict=True):
        out.append((doc, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = token_files.op11_token_files(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want_rows(docs, library([t for _, t in docs]))


def test_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; ids come back in order over several blocks and files."""
    docs = [(None, "no id"), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (6, " ".join(f"tok{i % 977} {i}" for i in range(9000))), (7, "ends \n ")]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOC).repartition(3)
    path = str(tmp_path / "ids")
    token_files.write_ids(df, path, token_files.tokenizer_path(), END)
    ids = library([t or "" for _, t in docs])
    assert sorted(map(tuple, token_files.read_documents(spark, path).collect()), key=lambda r: r[1]) == want_rows(docs, ids)
    back = {}
    for r in sorted(token_files.read_pieces(spark, path, with_ids=True).collect(), key=lambda r: (r["part"], r["ordinal"], r["first"])):
        assert len(r["ids"]) == r["length"] and r["crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        back.setdefault((r["part"], r["ordinal"]), []).extend(r["ids"])
    assert list(back.values()) == ids
    assert sum(r["n_ids"] for r in token_files.blocks(spark, path).collect()) == sum(map(len, ids))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(spark.createDataFrame([], DOC), path, token_files.tokenizer_path(), END)
    assert token_files.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("at", [0, 5, 30, -1])
def test_damaged_block(spark, tmp_path, at):
    path, bad = str(tmp_path / "ids"), str(tmp_path / "bad")
    token_files.write_ids(spark.createDataFrame([(1, "some words here", "x", 1, "y")], DOC), path, token_files.tokenizer_path(), END)
    row = token_files.blocks(spark, path).collect()[0].asDict()
    data = bytearray(row["data"])
    data[at] ^= 1
    spark.createDataFrame([tuple((row | {"data": bytes(data)}).values())], token_files.BLOCKS).write.parquet(bad)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_documents(spark, bad).collect()


def test_missing_block(spark, tmp_path):
    path, bad = str(tmp_path / "ids"), str(tmp_path / "bad")
    token_files.write_ids(spark.createDataFrame([(1, "w " * 10_000, "x", 1, "y")], DOC), path, token_files.tokenizer_path(), END)
    token_files.blocks(spark, path).where(F.col("block") != 1).write.parquet(bad)
    with pytest.raises(Exception, match="missing or repeated"):
        token_files.read_documents(spark, bad).collect()


def test_files_are_smaller_than_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    token_files.write_ids(docs, path, token_files.tokenizer_path(), END)
    n = token_files.blocks(spark, path).agg(F.sum("n_ids")).first()[0]
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) < 1.6 * n  # two bytes an id without a coder
