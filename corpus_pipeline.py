"""A training-data pipeline: toxicity, near duplicates, secrets, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as
Parquet to the shared folder and reads them again as the next stage's documents.

All stages take nulls in any column, empty and very long texts (whole), repeated rows, empty
tables and other columns, whatever their names; they pass other columns on, but for the last.

Stages lower the session's bound on Arrow batches to 8 MB and leave it there, as their rows are
computed after they return: a batch is held on both sides of a Python worker's pipe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import op2_mix, op4_secrets, op5_toxicity, op7_pieces, op10_jaccard
from tesserae.llm.common import documents, keep_small_batches, map_batches, materialize, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; all others go.

    A null text scores as an empty one; equal texts, and so repeated rows, fare alike. A null
    doc_id has no label, but its text is scored. Without usable labels every document stays.
    """
    keep_small_batches(spark)
    return op5_toxicity.accepted(docs, op5_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Rows of one doc_id are told apart by their texts; of equal ones one stays. Documents without
    words, and rows without a doc_id, link with nothing and stay.
    """
    keep_small_batches(spark)
    return op10_jaccard.first_of_groups(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars counted anew; a null text stays null, with n_chars null."""
    keep_small_batches(spark)
    return op4_secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are one source, empty texts are taken as the mix ranks them."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    taken = op2_mix.mix(docs, keep=others).where("copies > 0")
    repeated = taken.select("doc_id", "source", "kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(c if c in ("doc_id", "source") else f"kept.`{c}`") for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens of every document; a null text is an empty one and has no ids."""
    keep_small_batches(spark)
    shared = spark.sparkContext.broadcast(op7_pieces.model_bytes())

    def run(keys, sources, texts):
        ids = [op7_pieces.encode_text(x, shared.value) for x in texts]
        return [keys, sources, ids, [len(x) for x in ids]]

    return map_batches(docs.select("doc_id", "source", "text"), "doc_id long, source string, ids array<int>, n_tokens long", run, last=lambda: op7_pieces.forget(shared.value))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Similarity joins, learned weights and BPE are not for SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
