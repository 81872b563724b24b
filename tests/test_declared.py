"""Declared inputs, and what is refused."""

import json

import pytest

from evigrid.operators.generation import assertion, filled
from evigrid.sources import declared


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, value in files.items():
        (folder / f"{name}.yaml").write_text(value if isinstance(value, str) else json.dumps(value))
    return f"{folder}/*.yaml"


def test_questions(spark, tmp_path):
    pattern = put(tmp_path / "q", a="id: a\nentities: [x, y]\n", b={"id": "b", "name": {"native": "n"}, "budget_tokens": 7})
    assert {r["id"]: (r["budget_tokens"], r["deadline_ms"]) for r in declared.questions(spark, pattern).collect()} == {"a": (4000, 3000), "b": (7, 3000)}


@pytest.mark.parametrize("bad", [{"id": "c"}, {"id": "c", "entities": ["x"], "name": {"native": "n"}}])
def test_question_names_one_thing(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="exactly one"):
        declared.questions(spark, put(tmp_path / "q", c=bad))


def test_unknown_field(spark, tmp_path):
    with pytest.raises(Exception, match="not of this schema"):
        declared.documents(spark, put(tmp_path / "q", d={"id": "d", "more": 1}), declared.QUESTION).collect()


def test_principals(spark, tmp_path):
    rows = declared.principals(spark, put(tmp_path / "p", p={"principals": {"u": ["z", "a"], "v": []}})).collect()
    assert {r["principal"]: r["groups"] for r in rows} == {"u": ["a", "z"], "v": []}


def test_overlays(spark):
    a, b = spark.sql("SELECT 1 AS x"), spark.sql("SELECT 2 AS x")
    assert sorted(r["x"] for r in declared.with_overlays(a, b).collect()) == [1, 2]
    with pytest.raises(ValueError, match="only append"):
        declared.with_overlays(a, spark.sql("SELECT 2 AS y"))


def test_registry(spark, tmp_path):
    one = {"hub_id": "h", "procedures": [{"trigger": "t", "must_consult": ["k"]}]}
    pattern = put(tmp_path / "m", h=one, k={"hub_id": "k"})
    rows, version = declared.registry(spark, pattern)
    assert rows.count() == 2
    assert declared.registry(spark, pattern)[1] == version
    put(tmp_path / "m", k={"hub_id": "k", "role": "r"})
    assert declared.registry(spark, pattern)[1] != version
    put(tmp_path / "m", k={"hub_id": "other"})
    with pytest.raises(ValueError, match="must consult"):
        declared.registry(spark, pattern)
    put(tmp_path / "m", k={"hub_id": "h"})
    with pytest.raises(ValueError, match="declared once"):
        declared.registry(spark, pattern)


def test_memory_release(spark, tmp_path):
    entities = [{"id": "e", "member_of": []}, {"id": "f", "member_of": ["e"]}]
    put(tmp_path / "r1", release={"id": "r1", "entities": entities, "terms": [{"source": "s", "denotes": "f"}]})
    put(tmp_path / "r2", release={"id": "r2", "entities": entities, "terms": [{"source": "s", "denotes": "gone"}]})
    put(tmp_path / "r3", release={"id": "r1"})
    (tmp_path / "ACTIVE").write_text("r1\n")
    assert declared.memory_release(spark, str(tmp_path)).first()["id"] == "r1"
    with pytest.raises(ValueError, match="no entity"):
        declared.memory_release(spark, str(tmp_path), "r2")
    with pytest.raises(ValueError, match="not the release"):
        declared.memory_release(spark, str(tmp_path), "r3")


def test_build_rows(spark, tmp_path):
    for folder, hub in (("a", "a"), ("b", "b")):
        (tmp_path / "hubs" / folder).mkdir(parents=True)
        (tmp_path / "hubs" / folder / "artifacts.jsonl").write_text(json.dumps({"hub": hub, "artifact_id": hub}) + "\n")
    assert declared.build_rows(spark, str(tmp_path)).count() == 2
    (tmp_path / "hubs" / "b" / "artifacts.jsonl").write_text(json.dumps({"hub": "c", "artifact_id": "x"}))
    with pytest.raises(ValueError, match="without a folder"):
        declared.build_rows(spark, str(tmp_path)).count()


def test_templates(spark):
    with pytest.raises(ValueError, match="other"):
        filled("{name} {other}", {"name": None})
    from pyspark.sql import functions as F

    text, spans = filled("é{a}{b}.", {"a": F.lit("xy"), "b": F.lit(None)})
    row = spark.range(1).select(text.alias("t"), spans.alias("s")).first()
    assert (row["t"], [tuple(s) for s in row["s"]]) == ("éxy.", [("a", 1, 3), ("b", 3, 3)])
    rows = spark.createDataFrame([("f@r",), ("f@r/e",), ("none",)], "x string").select(assertion(F.col("x")).alias("a"))
    assert [r["a"] and tuple(r["a"]) for r in rows.collect()] == [("f", "r", None), ("f", "r", "e"), None]


def case(name, **more):
    spans = {"spans": [{"source_id": "s", "artifact_id": "a", "version": "v", "start": 0, "end": 2}]}
    one = {"case_id": name, "family": "f", "interpretation_policy": "unique", "request": {"request_id": "req-1", "query": "q"}, "interpretations": [{"interpretation_id": "i", "entity_ref": "e"}]}
    return one | {"obligations": [{"obligation_id": "o", "interpretation_id": "i", "weight": 2, "bundles": [spans]}]} | more


def test_cases(spark, tmp_path):
    one, two = put(tmp_path / "one", c1=case("c1")), put(tmp_path / "two", c2=case("c2", obligations=None))
    rows = {r["case_id"]: r for r in declared.cases(spark, one, two).collect()}
    assert (rows["c1"]["obligations"][0]["obtainable"], rows["c1"]["obligations"][0]["weight"], rows["c2"]["obligations"], rows["c2"]["relations"]) == (True, 2.0, [], [])
    with pytest.raises(ValueError, match="of one name"):
        declared.cases(spark, one, put(tmp_path / "three", c1=case("c3")))


@pytest.mark.parametrize("bad", [{"interpretations": []}, {"interpretation_policy": "separate_alternatives"}, {"request": {"request_id": "req-x"}}, {"obligations": [{"obligation_id": "o", "interpretation_id": "i", "weight": 0}]}])
def test_no_case(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="not a case"):
        declared.cases(spark, put(tmp_path / "c", x=case("x", **bad)))


def test_filler_dictionary(spark, tmp_path):
    good = {"services": [{"key": "k", "repo": "r", "skill_name": "s", "doc_space": "d", "memory_name": "m"}], "noise_sentences": ["a", "b", "c"]}
    rows = declared.filler_dictionary(spark, put(tmp_path / "f", filler=good))
    assert {tuple(r) for r in declared.filler_natives(rows).collect()} == {("codehub", "r"), ("skillhub", "s"), ("dochub", "d"), ("memoryhub", "m")}
    with pytest.raises(ValueError, match="three sentences"):
        declared.filler_dictionary(spark, put(tmp_path / "g", filler=good | {"noise_sentences": ["a"]}))


def test_providers(spark, tmp_path):
    rows = declared.providers(spark, put(tmp_path / "p", p={"providers": {"a": {"kind": "http", "api_key_env": "KEY", "capabilities": {"max_options": 3}}, "b": {"kind": "standin"}}})).collect()
    assert {r["name"]: (r["timeout_retry"], r["capabilities"]["max_options"], r["capabilities"]["primitives"]) for r in rows} == {"a": (1, 3, ["noul"]), "b": (1, 20, ["noul"])}
    for bad in ({"kind": "http", "timeout_retry": 2}, {"kind": "http", "capabilities": {"max_options": 0}}, {}):
        with pytest.raises(ValueError, match="out of its bounds"):
            declared.providers(spark, put(tmp_path / "bad", p={"providers": {"a": bad}}))


def test_template_of_hub_or_shared(spark, tmp_path):
    for name, text in (("h/doc", "own"), ("shared/doc", "common"), ("shared/note", "note")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.txt").write_text(text)
    wanted = spark.createDataFrame([("h", "doc"), ("k", "doc"), ("h", "note")], "hub string, kind string")
    assert {tuple(r) for r in declared.templates(spark, str(tmp_path), wanted).collect()} == {("h", "doc", "own"), ("k", "doc", "common"), ("h", "note", "note")}
    with pytest.raises(ValueError, match="no template"):
        declared.templates(spark, str(tmp_path), spark.createDataFrame([("h", "gone")], "hub string, kind string"))
