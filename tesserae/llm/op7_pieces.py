"""Operator 7: SentencePiece encoding and decoding, exact, by backtracking (see spm.py).

Texts are encoded whole. A null text is an empty one: no ids, decoded to "". White space of any
length, unknown characters (as byte pieces) and very long words need nothing special: a chunk of
a text is encoded in time linear in its length and only short chunks are remembered. Repeated
rows give repeated results, an empty table an empty result, other columns are dropped by the
query and kept by `encode`. There is no shuffle: a lost task is run again from its input split.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from . import spm
from .common import documents, map_batches

#: The vocabulary file that the queries use; operators take the file's content.
MODEL = "piece_bpe_32k.model"


def model_bytes(name: str = MODEL) -> bytes:
    """The model file, read on the driver (0.5 MB) and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def encode_text(text: str | None, raw: bytes) -> list[int]:
    model, cache = spm.load(raw)
    return list(chain.from_iterable(map(cache.__getitem__, model.chunks(text or ""))))


def forget(raw: bytes) -> None:
    """Empty a worker's caches: up to 200 MB, which it would hold as long as it lives."""
    model, cache = spm.load(raw)
    cache.clear()
    model.forget()


def encode(df: DataFrame, raw: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, ids array<int>, decoded string)."""
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(keys, texts):
        ids = [encode_text(x, shared.value) for x in texts]
        model, _ = spm.load(shared.value)
        return [keys, ids, [model.decode(x) for x in ids]]

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"`{key}` {kind}, ids array<int>, decoded string", run)


def digests(df: DataFrame, raw: bytes) -> DataFrame:
    """Rows of (doc_id, n_tokens, ids_sha256, decoded_sha256) without moving the ids to the JVM."""
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(keys, texts):
        model, _ = spm.load(shared.value)
        n, a, b, decimal = [], [], [], [str(i) for i in range(len(model.pieces))]
        for x in texts:
            ids = encode_text(x, shared.value)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return [keys, n, a, b]

    return map_batches(df.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), model_bytes())
