"""Fingerprints against plain Python: the same one-permutation MinHash by loops, and true Jaccard similarities."""

import hashlib
import re
import struct

import xxhash

from tesserae.llm import op1_fingerprints as op1


def chained(*values):
    """The engine's 64-bit hash of several values, signed: each is hashed with the hash of the ones before as its seed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def wide(x):
    return struct.pack("<q", x)


def narrow(x):
    return struct.pack("<i", x)


def shingle_words(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain_fingerprint(text):
    found = shingle_words(text)
    if not found:
        return ""
    if len(found[0]) < 5:
        hashes = [chained(" ".join(found[0])) & -2]
    else:
        hashes = [chained(*[wide(chained(w)) for w in s]) & -2 for s in found]
    bins = [None] * 256
    for h in hashes:
        b = (h >> 56) + 128
        bins[b] = h if bins[b] is None else min(bins[b], h)
    state, tables = 1, []
    for _ in range(op1.TRIES):
        tables.append([])
        for _ in range(256):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            tables[-1].append(state >> 56)
    full = [x for x in bins if x is not None]
    out = []
    for b in range(256):
        value = bins[b]
        for t in tables:
            value = bins[t[b]] if value is None else value
        if value is None:
            value = min((chained(narrow(b), wide(x >> 56)), x) for x in full)[1]
        out.append("0123456789abcdef"[chained(wide(value), narrow(b)) & 15])
    return "".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, min(1.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id", ascending=False).collect()
    texts = [r.text or "" for r in rows]
    got = {r.doc_id: r for r in op1.op1_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    errors = []
    for k, r in enumerate(rows):
        text, following, g = texts[k], texts[(k + 1) % len(rows)], got[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == plain_fingerprint(text) and g.edited_fingerprint == plain_fingerprint(edited)
        assert abs(g.near_edited - plain_likeness(g.fingerprint, g.edited_fingerprint)) < 1e-9
        assert abs(g.near_next - plain_likeness(g.fingerprint, plain_fingerprint(following))) < 1e-9
        for near, other in ((g.near_edited, edited), (g.near_next, following)):
            a, b = set(shingle_words(text)), set(shingle_words(other))
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.2 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04


def test_long_unbroken_and_repeated_texts(spark):
    rows = [(1, "x" * 300_000), (1, "x" * 300_000), (2, "w " * 50_000), (3, "a b"), (None, "a b"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", op1.fingerprint(op1.F.col("text")))
    for r in df.collect():
        assert r.f == plain_fingerprint(r.text or "")
