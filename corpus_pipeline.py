"""From documents to packed training sequences: five stages, each one operator of evigrid.llm over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import checkpointed, table
from evigrid.llm.decontaminate import clean_documents
from evigrid.llm.line_dedup import deduplicated
from evigrid.llm.ngram_join import similar_documents
from evigrid.llm.packing import packed, tokenizer_path
from evigrid.llm.quality import KEEP, graded, scored, trained


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likely stay; the model is fitted on the labels of these documents."""
    model = trained(docs, graded(table(spark, sf_dir, "labels")))
    return scored(docs, model).where(F.col("p_best") >= KEEP).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document of which nothing else remains goes with them."""
    rows = deduplicated(docs)
    empty = (F.col("n_dropped") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) == "")
    rows = rows.where(~F.coalesce(empty, F.lit(False)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays."""
    groups = similar_documents(docs, 5, 80)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, by the rule of the operator's query."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 1024 ids, with their ids."""
    return packed(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The classifier and the packing can't be said in SQL; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder before the next one."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
