"""Operator 1: document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the top bits choose one of BINS bins, the rest is the
value, and a bin keeps its least value. An empty bin is filled by optimal densification: it tries
bins in its own pseudo-random order, which depends on nothing but its number, and takes the value
of the first that isn't empty. Stored are BITS low bits of each bin's hash, packed into hex. Equal
bins then also come about by chance, which the likeness corrects: (m - c) / (1 - c), c = 2**-BITS.

All of it happens inside a row, so fingerprints need no shuffle. A text without words (null or
empty) has the fingerprint "", alike only to another "". With fewer than five words the whole
sequence is one shingle. Texts are lower-cased; words are split at space and the controls 9 to 13.

`with_next` pairs every row with the next one by descending id without a global sort: ids are cut
into ranges at approximate quantiles that are ids themselves, so each range starts with a known
row, of which the range before gets a copy; then ranges are ordered on their own. Null ids come
last; rows of one id are ordered by text. Texts of any length are taken whole, in one row. Repeated
rows have equal fingerprints. Other columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import GAP, documents, let

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
WORDS = 5
#: Tries in the bin's own order before the whole of the order is computed.
TRIES = 10


def _shingle_hashes(words: Column) -> Column:
    """One hash for each run of WORDS words; the lowest bit is 0, so that none equals an empty bin."""
    clear = F.lit(-2).cast("long")
    long = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]).bitwiseAND(clear)),
    )
    return F.when(F.size(words) >= WORDS, long).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words)).bitwiseAND(clear)))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _tries() -> list[Column]:
    """For each try an array: the bin that an empty bin, by number, looks at."""
    state, out = 1, []
    for _ in range(TRIES):
        row = []
        for _ in range(BINS):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            row.append(state >> 64 - BIN_BITS)
        out.append(F.expr(f"array({','.join(map(str, row))})"))
    return out


def fingerprint(text: Column) -> Column:
    """Packed low-order bits of the densified bins as hex; "" for a text without words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")
    # an empty bin's mark is its greatest value, all ones, so that it sorts last in its bin
    marks = F.expr(f"array({','.join(f'{(b - BINS // 2 + 1 << 64 - BIN_BITS) - 1}L' for b in range(BINS))})")
    one, tries = F.lit(1).cast("long"), _tries()
    digits = F.expr("split('0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f', ',')")

    def of_hashes(h: Column) -> Column:
        """The least value of each bin, in the order of bins; null for an empty bin."""
        ranked = F.sort_array(F.concat(h, marks))
        least = let(ranked, lambda r: F.filter(r, lambda x, i: F.coalesce(_bin(x) != _bin(F.get(r, i - 1)), F.lit(True))))
        return let(F.transform(least, lambda x: F.when(x.bitwiseAND(one) == 0, x)), packed)

    def packed(least: Column) -> Column:
        def dense(full: Column) -> Column:
            def digit(own: Column, b: Column) -> Column:
                order = F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("o"), x.alias("x"))))
                value = F.coalesce(own, *[F.get(least, F.get(t, b)) for t in tries], order["x"])
                # hashed with the bin's number: else copies of one value would agree or differ all at once
                return F.get(digits, F.xxhash64(value, b).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int"))

            return F.array_join(F.transform(least, digit), "")

        return let(F.array_compact(least), dense)

    return let(words, lambda w: F.when(F.size(w) > 0, let(_shingle_hashes(w), of_hashes)).otherwise(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, corrected for chance, in [0, 1]."""
    # equal digits are zeros of the exclusive or, sixteen digits (a long) at a time
    same = F.lit(0)
    for k in range(0, BINS, 16):
        x = F.conv(F.substring(a, k + 1, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring(b, k + 1, 16), 16, -10).cast("long"))
        same = same + 16 - F.length(F.regexp_replace(F.lpad(F.lower(F.hex(x)), 16, "0"), "0", ""))
    chance = 2.0**-BITS
    near = (same / BINS - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def with_next(df: DataFrame, columns: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Each row with `next_<column>` of the next row by descending doc_id; after the last, of the first."""
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = df.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).first()
    cuts = sorted({x for x in [got.top, *(got.cuts or [])] if x is not None}, reverse=True)  # each starts a range
    if cuts:
        starts = F.array(*[F.lit(c).cast("long") for c in cuts])
        at = F.when(F.col("doc_id").isNull(), len(cuts) - 1).otherwise(_range(cuts))
    else:
        at = F.lit(0)
    is_start = F.array_contains(starts, F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))) if cuts else F.lit(True)
    df = df.withColumn("_range", at.cast("int"))
    copies = F.when(is_start, F.array(F.col("_range"), F.pmod(F.col("_range") - 1, F.lit(max(1, len(cuts)))))).otherwise(F.array(F.col("_range")))
    df = df.withColumn("_copy", copies).select("*", F.posexplode("_copy").alias("_k", "_in")).drop("_copy", "_range")
    order = W.partitionBy("_in").orderBy("_k", F.col("doc_id").desc_nulls_last(), F.col("text"))
    for c in columns:
        df = df.withColumn(f"next_{c}", F.lead(c).over(order))
    return df.where("_k = 0").drop("_k", "_in")


def _range(cuts: list[int]) -> Column:
    """The number of the range of doc_id, that of the least start that isn't below it, by bisection."""

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > cuts[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(cuts))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ("text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
