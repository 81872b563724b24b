from evigrid import catalog


def test_whole_trusted_texts(spark, tmp_path):
    """What is handed over is whole: texts that differ late differ."""
    docs = [(1, "a" * 2000 + "x", "en"), (2, "a" * 2000 + "y", "fr"), (3, "a", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(7, kind, f'{{"k": {k}}}') for k in (1, 2, 3) for kind in ("purchase", "view")]
    spark.createDataFrame(events, "user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["whole_trusted_texts"](spark, str(tmp_path)).collect()
    assert {(r["request_id"], r["artifact_id"], r["text"]) for r in got} == {(7, d, t) for d, t, _ in docs[:2]}
    digests = {r["text"] for r in catalog.queries()["trusted_texts"](spark, str(tmp_path)).collect()}
    assert len(digests) == 2 and {len(x) for x in digests} == {64}
