"""The hub and change sources: pushed filters, held-back hubs, refused folders, broken lines, offsets over restarts."""

import json

import pytest
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from evigrid.sources import hubs
from evigrid.streaming.feed import drained


@pytest.fixture
def folder(tmp_path):
    for hub, n in (("a", 3), ("b", 5), ("c", 0)):
        (tmp_path / f"hub={hub}").mkdir()
        rows = [{"artifact_id": f"{hub}{i}", "acl": ["g"], "text": f"text {i}\nü", "metadata": {"revision": ["2", "x", None][i % 3], "principal": "ann" if i == 1 else None}} for i in range(n)]
        (tmp_path / f"hub={hub}" / "part-0.txt").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
        (tmp_path / f"hub={hub}" / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_hub_rows(spark, folder):
    got = {r["artifact_id"]: r for r in hubs.hubs(spark, folder).collect()}
    assert set(got) == {"a0", "a1", "a2", "b0", "b1", "b2", "b3", "b4"}
    assert (got["a0"]["revision"], got["a1"]["revision"], got["a2"]["revision"], got["b1"]["owner"], got["b0"]["text"]) == (2, 0, 0, "ann", "text 0\nü")
    assert {r["hub"] for r in hubs.hubs(spark, folder, held_back=("b",)).collect()} == {"a"}
    assert {r["artifact_id"] for r in hubs.hubs(spark, f"file://{folder}").where("hub = 'b' AND artifact_id IN ('b1', 'b4', 'a1')").collect()} == {"b1", "b4"}


def test_pushed_filters(folder):
    """What is pushed narrows the files that are opened; what isn't stays with Spark."""
    reader = hubs.HubReader({"path": folder})
    starts = StringStartsWith(("hub",), "a")
    assert list(reader.pushFilters([EqualTo(("hub",), "a"), In(("hub",), ("a", "b")), starts, In(("artifact_id",), ("a2",))])) == [starts]
    parts = reader.partitions()
    assert [p.hub for p in parts] == ["a"]
    assert [b.column(1).to_pylist() for b in reader.read(parts[0])] == [["a2"]]


def test_refused(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="private"):
        hubs.HubReader({"path": f"{tmp_path}/private/x"}).partitions()
    (tmp_path / "hub=a" / "part-1.txt").write_text("{broken\n")
    with pytest.raises(Exception, match="JSON|Expecting"):
        hubs.hubs(spark, folder).where("hub = 'a'").collect()
    assert hubs.hubs(spark, f"{folder}/nowhere").count() == 0


def test_changes(spark, tmp_path):
    """Each change once, in parts that overlap a cursor, over a restart, from an offset of one's own."""
    hubs.register(spark)
    log, rows = f"{tmp_path}/log", spark.createDataFrame([(i, "h", "k", f"s{i}") for i in range(1, 11)], hubs.CHANGE)

    def read(work, **options):
        stream = spark.readStream.format("changes").options(**options).load(log)
        drained(stream, f"{tmp_path}/{work}", lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/{work}/rows/batch={i}"))
        return sorted(r["seq"] for r in spark.read.schema(hubs.CHANGE).parquet(f"{tmp_path}/{work}/rows").collect())

    hubs.append_log(log, rows, 1, 4)
    assert read("one") == [1, 2, 3, 4]
    hubs.append_log(log, rows, 5, 7)
    hubs.append_log(log, rows, 8, 10)
    assert read("one") == list(range(1, 11))
    assert read("two", after="6") == [7, 8, 9, 10]
