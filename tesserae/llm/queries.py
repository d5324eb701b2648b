"""The queries of this subpackage and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .op1_fingerprints import op1_fingerprints
from .op2_mix import op2_mix
from .op3_tokens import op3_token_counts
from .op4_secrets import op4_secret_scan
from .op5_toxicity import op5_toxicity
from .op6_chat import ORACLE as CHAT_ORACLE
from .op6_chat import op6_chat_format
from .op7_pieces import op7_sentencepiece
from .op8_media import op8_media
from .op9_pii import op9_pii
from .op10_jaccard import op10_jaccard_join


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.py at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mix": op2_mix,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_media": op8_media,
    "op9_pii": op9_pii,
    "op10_jaccard_join": op10_jaccard_join,
    "pipeline": pipeline,
}

ORACLES = {"op6_chat_format": CHAT_ORACLE}
