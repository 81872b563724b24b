"""Folders for what a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or, where that is unset and all runs on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="streams")
    return f"{root}/stream-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder: computed once, whoever reads them."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
