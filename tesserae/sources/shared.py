"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable(spark: SparkSession) -> str:
    """The checkpoint folder; one of our own only where none is configured, on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/tesserae-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top


def written(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """Write rows to the shared folder and read them again: computed once, and no executor's loss takes them.

    `batch` bounds the Arrow batches that Python workers get meanwhile.
    """
    path = f"{durable(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, batch or before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
