"""Operator 3: token counts by a compiled transducer (see transducer.py), without building tokens.

A null text is an empty one with 0 tokens. Whole texts are counted, however long; repeated rows
give repeated results, an empty table an empty result; columns other than the key and the text
are not read. There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import transducer
from .common import documents, map_batches
from .op7_pieces import model_bytes

LIMIT = 4096


def count_text(text: str | None, raw: bytes) -> int:
    model, cache = transducer.load(raw)
    return sum(map(cache.__getitem__, model.chunks(text or "")))


def token_counts(df: DataFrame, raw: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, n_bytes, n_tokens)."""
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(keys, texts):
        return [keys, [len((x or "").encode()) for x in texts], [count_text(x, shared.value) for x in texts]]

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"`{key}` {kind}, n_bytes long, n_tokens long", run)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), model_bytes()).withColumn("over_limit", F.col("n_tokens") > LIMIT)
