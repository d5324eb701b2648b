"""Operator 8: media columns of baseline JPEG files (see jpeg.py).

`media` makes a column of files from texts; `inspect` reads a column of files: width, height,
DC-only luminance thumbnail, thumbnail hash and mean luminance. The query stores each text as the
DC coefficients of an image, reads the files back and derives its digests from what it has read.

A null text is an empty one, stored as 64 zero bytes. Files that aren't baseline JPEG, cut off or
forged, and null ones, give nulls in `inspect`. Texts of any length are one file, of several images
one after the other beyond 4 MB; `inspect` describes the first. Equal texts give equal files, and
repeated rows repeated results. Nothing is shuffled; batches are cut to some MB of payload. Other
columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession

from . import jpeg
from .common import documents, map_batches

#: Payload bytes that are decoded side by side.
SIDE_BY_SIDE = 4_000_000


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, media binary)."""
    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"`{key}` {kind}, media binary", lambda keys, texts: [keys, [jpeg.store(payload(x)) for x in texts]])


#: What a damaged file may raise while it is read.
_BROKEN = (ValueError, IndexError, KeyError, TypeError, ArithmeticError, struct.error, MemoryError)


def _read(files: list[bytes]) -> list:
    """(header, thumbnail) of each file; None for what isn't a baseline JPEG."""
    out: list = []
    lo = size = 0
    for i, x in enumerate(files):
        size += len(x or b"")
        if size >= SIDE_BY_SIDE or i == len(files) - 1:
            part = files[lo : i + 1]
            try:
                out += jpeg.thumbnails(part)
            except _BROKEN:
                for one in part:
                    try:
                        out += jpeg.thumbnails([one])
                    except _BROKEN:
                        out.append(None)
            lo, size = i + 1, 0
    return out


def feature(h: jpeg.Header, image) -> str:
    return f"{h.width}x{h.height}:{jpeg.grey_hash(image)}:{image.mean():.3f}"


def inspect(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Rows of (key, width, height, thumbnail, thumbnail_hash, luminance)."""

    def run(keys, files):
        got = _read(files)
        return [
            keys,
            [g and g[0].width for g in got],
            [g and g[0].height for g in got],
            [g and g[1].tobytes() for g in got],
            [g and jpeg.grey_hash(g[1]) for g in got],
            [g and float(g[1].mean()) for g in got],
        ]

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, column), f"`{key}` {kind}, width int, height int, thumbnail binary, thumbnail_hash string, luminance double", run)


def digests(df: DataFrame) -> DataFrame:
    """Rows of what is read back from each text's file, by doc_id."""

    def run(keys, texts):
        rows = [[] for _ in range(7)]
        files = [jpeg.store(payload(x)) for x in texts]
        parts = [jpeg.images(f) for f in files]
        read = iter(_read([p for x in parts for p in x]))
        for x, f, p in zip(texts, files, parts, strict=True):
            got = [next(read) for _ in p]
            back = b"".join(jpeg.restore(h, image) for h, image in got)
            shown = ",".join(feature(h, image) for h, image in got)
            values = (len((x or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), shown)
            for column, v in zip(rows, values, strict=True):
                column.append(v)
        return [keys, *rows]

    return map_batches(df.select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
