from evigrid import catalog


def test_revision_diff_after_gap(spark, tmp_path):
    """The version before is the nearest one, as lag() has it, whatever turns are missing."""
    turns = [(1, 1, "user"), (1, 3, "assistant"), (2, 1, "user"), (2, 2, None), (2, 4, "assistant"), (3, 5, "user"), (3, 9, "user")]
    spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["revision_diff"](spark, str(tmp_path)).collect()
    assert [(r["artifact_id"], r["revision"], r["role_before"], r["role_after"]) for r in got] == [(1, 3, "user", "assistant")]
