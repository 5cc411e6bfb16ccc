"""Cutting lineage: a result that several later steps read is computed once and kept as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in ``spark.checkpoint.dir``; a local folder only where that is unset and the master is local."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{folder or 'file://' + tempfile.mkdtemp(prefix='foliospark-')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
