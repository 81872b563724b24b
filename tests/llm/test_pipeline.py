from oracle import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as p


def test_stages(spark):
    """Each stage keeps the columns of documents and does what its operator says, on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = p.checkpointed(stage(spark, kept, SMALL))
        assert kept.columns == docs.columns, name
    assert 0 < kept.count() < docs.count()
    groups = p.similar_documents(kept, 5, 80)
    assert groups.where("doc_id <> component_id").count() == 0
    from evigrid.llm.decontaminate import contamination

    assert contamination(kept, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("contaminated").count() == 0
    pieces = p.packing(spark, kept, SMALL)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
    toxic = spark.read.parquet(f"{SMALL}/labels.parquet").where(F.col("toxic") > 0)
    assert kept.join(toxic, "doc_id", "left_semi").count() <= 0.05 * toxic.count()


def plain_stages(docs, model, items, labels):
    """The first four stages over a list of (doc_id, text), by plain loops."""
    import numpy as np
    import pyarrow as pa
    from plain import brute_force
    from test_operators import groups

    from evigrid.llm import decontaminate, quality

    scores = [float(model.weights[f].sum()) for f in quality.features(pa.array([t for _, t in docs], pa.string()))]
    docs = [d for d, s in zip(docs, scores, strict=True) if 1 / (1 + np.exp(-(s - model.thresholds[-1]))) >= quality.KEEP]
    gone = brute_force(docs)
    cut = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        if len(kept) == len(lines) or "".join(kept).strip(" "):
            cut.append((d, t if len(kept) == len(lines) else "\n".join(kept)))
    component = groups(cut, 5, 80)
    docs = [(d, t) for d, t in cut if component[d][1] == d]
    windows = set()
    for _, t in items:
        ws = decontaminate.words_of(t)
        windows |= {tuple(ws[i : i + 13]) for i in range(max(1, len(ws) - 12)) if ws}
    out = []
    for d, t in docs:
        ws = decontaminate.words_of(t)
        hit = {j for n in {len(w) for w in windows} for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(ws):
            out.append((d, t))
    return out


def test_run_by_brute_force(spark, tmp_path):
    """run() over a folder of tables with nulls, empty and repeated texts, ties and another column, against plain loops and a round trip of ids."""
    import tokenizers

    from evigrid.llm import packing, quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").withColumn("ids", F.lit("x"))
    more = [(1000, None), (1001, ""), (1002, "one line only\nshort"), (1003, "one line only\nshorter still"), (1004, "One line only ")]
    more = spark.createDataFrame(more, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src1' AS source", "coalesce(length(text), 0) AS n_chars", "'y' AS ids")
    docs = docs.unionByName(more.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.trained(docs, quality.graded(labels))
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_stages(sorted(tuple(r) for r in docs.select("doc_id", "text").collect()), model, items, labels)
    own, pieces = tokenizers.Tokenizer.from_file(packing.tokenizer_path()), {}
    for r in sorted(p.run(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["start"])):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], []) + list(r["ids"])
    assert 0 < len(want) < docs.count()
    assert pieces == {d: [*own.encode(t or "", add_special_tokens=False).ids, 0] for d, t in want}


def test_run_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
