"""Hub folders, JSON lines and logs."""

import json

import pytest

from evigrid.sources import files

ROW = {"hub": "h", "acl": ["a"], "artifact_id": "x", "kind": "doc", "metadata": {"revision": "2", "principal": "p"}, "text": "t", "title": "T", "version": "v"}


def hub(folder, *lines):
    folder.mkdir(parents=True)
    (folder / "artifacts.jsonl").write_text("\n".join(lines))
    (folder / "capabilities.json").write_text(json.dumps({"hub": "h", "version_reads": True, "place_version_reads": {"a": False}}))
    return str(folder)


def test_hub_folder(spark, tmp_path):
    folder = hub(tmp_path / "h", json.dumps(ROW), "", json.dumps(ROW | {"metadata": {"revision": "odd"}}))
    assert {r["revision"]: r["owner"] for r in files.hub_artifacts(spark, folder).collect()} == {2: "p", 0: None}
    assert files.hub_capabilities(spark, folder).select(files.reads_versions("a"), files.reads_versions("b")).first()[:] == (False, True)


@pytest.mark.parametrize("line", [json.dumps(ROW | {"more": 1}), "{broken"])
def test_bad_lines(spark, tmp_path, line):
    with pytest.raises(Exception, match="not a row"):
        files.hub_artifacts(spark, hub(tmp_path / "h", line)).collect()


def test_guard(spark, tmp_path):
    with pytest.raises(ValueError, match="private"):
        files.hub_artifacts(spark, hub(tmp_path / "private" / "h"))
    with pytest.raises(ValueError, match="nothing else"):
        files.check_hub_folder(spark, str(tmp_path / "none"))


def test_sorted_keys(spark, tmp_path):
    files.write_json_lines(spark.sql("SELECT 1 AS b, named_struct('z', 1, 'a', CAST(NULL AS INT)) AS a").coalesce(1), str(tmp_path / "o"))
    assert [x for p in (tmp_path / "o").glob("*.txt") for x in p.read_text().split()] == ['{"a":{"a":null,"z":1},"b":1}']


def test_change_log(spark, tmp_path):
    log = str(tmp_path / "log")
    events = spark.createDataFrame([(i, "h", "rename", f"s{i}", i, False) for i in (3, 1, 2)], "at bigint, hub string, kind string, subject string, at_revision bigint, principal_scoped boolean")
    for _ in range(2):
        files.append_changes(log, events)
    assert sorted((r["seq"], r["subject"]) for r in files.change_log(spark, log).collect()) == [(i + 1, f"s{i % 3 + 1}") for i in range(6)]
    assert files.change_log(spark, log, 4).count() == 2


def test_run_once(spark, tmp_path):
    log = str(tmp_path / "runs")
    files.claim_run(spark, log, "m", "c")
    files.record_run(spark, log, "m", "c", "ok")
    files.claim_run(spark, log, "m", "other")
    with pytest.raises(ValueError, match="has run"):
        files.claim_run(spark, log, "m", "c", force=True)
    files.claim_run(spark, log, "m", "c", True, "new data")
