"""Substring search by sampled grams, and the leak scan built on it."""

import numpy as np
import pytest

from evigrid.functions.grams import LEAST_BYTES, RUNS, around, edges, runs, signature, signatures
from evigrid.operators import leaks
from evigrid.operators.containment import occurrences

STRINGS, TEXTS = "string_id long, string string", "text_id long, text string"


def plain(strings, texts):
    out = []
    for s, x in strings:
        for k, t in texts:
            if x is not None and t is not None:
                out += [(s, k, i, t[i - 1 : i] if i else "", t[i + len(x) : i + len(x) + 1]) for i in range(len(t) - len(x) + 1) if t.startswith(x, i)]
    return sorted(out)


def test_signature_is_shared():
    """Any common run of twelve bytes has a common gram at the same place of it."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        common = bytes(rng.integers(97, 100, LEAST_BYTES + rng.integers(0, 9)).tolist())
        before, after = bytes(rng.integers(97, 100, 9).tolist()), bytes(rng.integers(97, 100, 9).tolist())
        places, grams = signature(before + common + after)
        own = set(zip(*(x.tolist() for x in signature(common)), strict=True))
        assert own and own <= {(p - 9, g) for p, g in zip(places.tolist(), grams.tolist(), strict=True)}
    assert len(signature(b"short")[0]) == 0


def test_occurrences(spark):
    """Against trying every place: overlaps, repeats, other alphabets, a string in none, whole texts, nulls, empty and long texts."""
    rng = np.random.default_rng(2)
    texts = [(i, "".join(rng.choice(list("abé日 "), 400))) for i in range(20)]
    strings = [(i, t[10 * (i % 7) : 10 * (i % 7) + 14]) for i, t in texts] + [(50, "a" * 13), (51, "nowhere to be found"), (52, None), (53, texts[0][1])]
    texts += [(30, "a" * 40), (31, None), (32, ""), (33, "x" * 300_000 + strings[3][1]), (34, strings[3][1] * 3)]
    got = occurrences(spark.createDataFrame(strings, STRINGS), spark.createDataFrame(texts, TEXTS)).collect()
    want = plain(strings, texts)
    assert sorted(map(tuple, got)) == want and len(want) > 40


def test_little_is_written(spark, monkeypatch):
    """All lines of all texts are looked for: what is written on the way grows with occurrences, not with the letters."""
    from evigrid.operators import containment

    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(60)]
    texts = [(i, "\n".join(lines[i % 50 : i % 50 + 4])) for i in range(80)]
    rows, kept = [], containment.written
    monkeypatch.setattr(containment, "written", lambda df: rows.append(kept(df)) or rows[-1])
    got = occurrences(spark.createDataFrame(list(enumerate(lines)), STRINGS), spark.createDataFrame(texts, TEXTS)).collect()
    assert sorted(map(tuple, got)) == plain(list(enumerate(lines)), texts)
    assert sum(r.count() for r in rows) <= 2 * (len(got) + len(lines))


def test_few_places_go_to_the_texts(spark, tmp_path):
    """A string in few of many texts: the places found are sent to the texts, and texts are not shuffled to them."""
    spark.range(400).selectExpr("id AS text_id", "repeat(concat('words of text ', id, ', '), 2000) AS text").write.parquet(str(tmp_path / "texts"))
    got = occurrences(spark.createDataFrame([(1, "words of text 77, w")], STRINGS), spark.read.parquet(str(tmp_path / "texts")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.count() == 1999


def test_grams_of_many_texts_at_once(spark):
    """Grams are taken as each text alone has them, in all lengths around a window's, equal letters too."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice([97, 98], n).tolist()) for n in (*range(30), *range(29, -1, -1))] + [b"", b"a" * 40, b"", b"ab" * 20]
    of, places, grams = (x.tolist() for x in signatures(texts))
    assert [*zip(of, places, grams, strict=True)] == [(i, p, g) for i, t in enumerate(texts) for p, g in zip(*(x.tolist() for x in signature(t)), strict=True)]
    for i, t in enumerate(texts):
        own = [p for k, p in zip(of, places, strict=True) if k == i]
        assert all(0 <= p <= len(t) - 8 for p in own) and all(any(w <= p < w + 5 for p in own) for w in range(len(t) - LEAST_BYTES + 1))
        assert [g for k, g in zip(of, grams, strict=True) if k == i] == [int.from_bytes(t[p : p + 8], "little", signed=True) for p in own]


def test_runs_of_a_string_are_in_its_texts():
    """All runs of taken grams of a string have the same keys in a text that holds it, and around them stand the same letters."""
    rng = np.random.default_rng(4)
    for _ in range(100):
        common = bytes(rng.integers(97, 100, LEAST_BYTES + rng.integers(0, 60)).tolist())
        texts = [b"", bytes(rng.integers(97, 100, rng.integers(0, 20)).tolist()) + common + bytes(rng.integers(97, 100, rng.integers(0, 20)).tolist())]
        at = texts[1].index(common)
        of, places, grams = signatures(texts)
        for length, own, keys in zip(RUNS, runs(*(mine := signatures([common]))), runs(of, places, grams), strict=True):
            first = mine[1][: len(own)]
            assert len(own) == max(0, len(mine[1]) - length + 1)
            assert {*zip((first + at).tolist(), own.tolist(), strict=True)} <= {*zip(places[: len(keys)].tolist(), keys.tolist(), strict=True)}
    n = np.array([0, 1, 4, 3]), np.array([4, 2, 0, 3])
    got = around([b"abcdefgh", b"xy"], np.array([0, 0, 1, 1]), np.array([4, 1, 0, 1]), np.array([4, 7, 2, 2]))
    assert [x.tobytes() for x in got] == [b"abcdefgh", b"\xff\xff\xffah\xff\xff\xff", b"\xff" * 8, b"\xff\xff\xffx\xff\xff\xff\xff"]
    assert [x.tobytes() for x in edges(*n)] == [bytes(4 - a) + b"\xff" * a + b"\xff" * b + bytes(4 - b) for a, b in zip(*n, strict=True)]


def test_short_strings_are_refused(spark):
    with pytest.raises(Exception, match="at least 12 bytes"):
        occurrences(spark.createDataFrame([(1, "short")], STRINGS), spark.createDataFrame([(1, "a short text, too")], TEXTS)).collect()


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], STRINGS), spark.createDataFrame([(1, "some text or other")], TEXTS)
    assert occurrences(none, some).count() == 0
    assert occurrences(spark.createDataFrame([(1, "some text or other")], STRINGS), some.where("false")).count() == 0


ARTIFACTS = [
    # artifact_id, acl, owner, restricted, title, lines, paths, canary
    (1, ["eng"], None, False, "Retry policy guide", ["the limit of retries is seven attempts", "public final class Retry {"], ["repo/retry-policy.md", "repo/retry-policy.md@v1"], None),
    (2, ["ops"], None, False, "Operations handbook", ["final class Retry", "only operators may read this line here"], ["ops/sampling-106.md"], "canary-ops-000001"),
    (3, ["sec"], None, True, "Incident of the year", ["the root password was written down once"], [], "canary-sec-000002"),
    (4, ["eng"], "ann", False, "Session note of ann", ["ann asked about the retry limit today"], [], None),
    (5, ["sec"], None, True, "Another secret file", ["the limit of retries is seven attempts"], [], None),
]


def test_leaks(spark):
    rows = [
        (1, "bob", ["eng"], "see: only operators may read this line here.", None),  # another group's line
        (2, "bob", ["eng"], "final class Retry is fine, the limit of retries is seven attempts", None),  # inside readable text
        (3, "bob", ["eng"], "x Incident of the year y, pre-Operations handbook", None),  # a title, and one that isn't whole
        (4, "bob", ["eng"], "ann asked about the retry limit today", None),  # someone else's note
        (5, "ann", ["eng"], "ann asked about the retry limit today", None),  # her own
        (6, None, None, "only operators may read this line here; the root password was written down once", None),  # no principal: restricted only
        (7, "bob", ["eng"], "only operators may read this line here", "why: only operators may read this line here?"),  # an echo
        (8, "cy", ["sec", "ops"], "canary-ops-000001 canary-sec-000002", None),
        (9, "bob", [], "canary-ops-000001, twice canary-ops-000001; ops/sampling-106.md; token-ops/sampling-106.md", None),
        (10, "bob", ["eng"], None, None),
    ]
    got = leaks.leaks(spark.createDataFrame(ARTIFACTS, leaks.ARTIFACT), spark.createDataFrame(rows, "row_id long, principal string, groups array<string>, text string, request_text string"))
    assert sorted((r["row_id"], r["principal"], r["kind"], r["token"], r["start"], r["n"]) for r in got.collect()) == [
        (1, "bob", "private_text", "only operators may read this line here", 5, 1),
        (3, "bob", "restricted_title", "Incident of the year", 2, 1),
        (4, "bob", "private_text", "ann asked about the retry limit today", 0, 1),
        (6, None, "restricted_text", "the root password was written down once", 40, 1),
        (9, "bob", "canary", "canary-ops-000001", 0, 2),
        (9, "bob", "private_path", "ops/sampling-106.md", 44, 1),
    ]


ROW = "row_id long, principal string, groups array<string>, text string, request_text string"


def _watched(monkeypatch):
    """All that leaks writes on its way."""
    from evigrid.operators import containment

    frames, kept = [], leaks.written
    for module in (leaks, containment):
        monkeypatch.setattr(module, "written", lambda df: frames.append(kept(df)) or frames[-1])
    return frames


def test_tokens_stay_with_their_texts(spark, monkeypatch):
    """Long lines that leak: neither they nor texts are written on the way, and the result doesn't shuffle them once it has cut them from the row."""
    rng = np.random.default_rng(6)
    lines = ["".join(rng.choice(list("abcdefghijklmnop "), 20_000)) for _ in range(40)]
    artifacts = [(i, ["ops"], None, False, None, [x], [], None) for i, x in enumerate(lines)]
    frames = _watched(monkeypatch)
    got = leaks.leaks(spark.createDataFrame(artifacts, leaks.ARTIFACT), spark.createDataFrame([(i, "bob", ["eng"], "x" + t, None) for i, t in enumerate(lines)], ROW))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    assert sorted((r["row_id"], r["token"], r["start"]) for r in got.collect()) == [(i, t, 1) for i, t in enumerate(lines)]
    sizes = [f.selectExpr("coalesce(sum(length(to_json(struct(*)))), 0) AS n").first()["n"] for f in frames]
    assert sum(sizes) < len("".join(lines)) / 10


@pytest.mark.parametrize("few", [0, 60])
def test_standing(spark, monkeypatch, few):
    """Few places go to the texts, many don't, and only texts of which something is wanted are shuffled to them."""
    from evigrid.operators import containment

    monkeypatch.setattr(containment, "FEW", few)
    texts = spark.range(500).selectExpr("id AS text_id", "'n' || id AS name", "IF(id = 9, NULL, concat('é text ', id, ' text ', id)) AS text")
    places = [(i, at, len(word), containment._digest(word.encode()), i % 3) for i in range(0, 20, 2) for word in (f"text {i} text {i}", f"text {i}") for at in (3, 9 + len(str(i)), 70)]
    wanted = spark.createDataFrame(places, "text_id long, at long, bytes long, digest binary, note int").selectExpr("text_id", "struct(at, bytes, digest, note) AS w").groupBy("text_id").agg({"w": "collect_list"}).toDF("text_id", "w")
    got = containment.standing(wanted, texts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (few > 0) and ("SortMergeJoin" in plan) == (few == 0)
    second = lambda i: 8 + len(str(i))
    want = [(i, f"n{i}", i % 3, f"text {i}", [(2, " ", " "), (second(i), " ", "")]) for i in range(0, 20, 2)] + [(i, f"n{i}", i % 3, f"text {i} text {i}", [(2, " ", "")]) for i in range(0, 20, 2)]
    assert sorted((r["text_id"], r["name"], r["note"], r["token"], [tuple(p) for p in r["places"]]) for r in got.collect()) == sorted(want)
    assert 10 <= containment.among(texts, wanted).count() < 20


def test_titles_that_all_may_read_are_not_collected(spark, monkeypatch):
    """Each title of two words stands in each text, and all may read it there: what is written grows with the titles, not with titles times texts."""
    words = [f"word{x}" for x in "abcdefgh"]
    said = [f"number {10_000 + 7919 * i} " + " ".join(f"{a} {b} {b}" for a in words for b in words) for i in range(128)]
    artifacts = [(i, ["eng", "ops"][i % 2 :][:1], None, False, f"{words[i // 8]} {words[i % 8]} ", [said[i]], [], None) for i in range(64)]
    frames = _watched(monkeypatch)
    rows = [(i, "bob", ["eng"], said[i], None) for i in (*range(0, 128, 2), 1)]
    got = leaks.leaks(spark.createDataFrame(artifacts, leaks.ARTIFACT), spark.createDataFrame(rows, ROW)).collect()
    assert [(r["row_id"], r["kind"], r["token"]) for r in got] == [(1, "private_text", said[1])]
    assert sum(f.count() for f in frames) < 6 * 128


def test_withheld_counts(spark):
    rows = spark.createDataFrame([(1, "bob", "There are 3 restricted results"), (2, "cy", "3 hidden"), (3, None, "withheld pages: 2, hidden count = 0"), (4, "bob", "three hidden")], "row_id long, principal string, text string")
    assert sorted(map(tuple, leaks.withheld_counts(rows, ("cy",)).collect())) == [(1, "3 restricted"), (3, "withheld pages: 2")]
