"""Operator 10: n-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large.

Documents are sets of five-word shingles; two link when their Jaccard similarity is 0.8 or more.
Every link is found (no cap on partners or candidates), though not every pair is written: the
result is one row for each document with its component. Equal sets are one class by their digest.

1. Prune. In order of hash, each set sends its first n - ceil(0.8 n) + ceil(0.1 n) shingles to
   buckets of the hash space. Linked sets have at least ceil(0.1 n) of these in common, so a set
   of which fewer are met by any other set links with nothing. Most documents end here. A worker
   sends a shingle once for a block of documents, however many of them hold it.
2. Of what is left, only shingles of two or more sets count. Each set keeps them, the rarest
   first; sets that have less than 0.8 n of them go.
3. Small sets: sets of a and b shingles that link share a subset of ceil(4 (a + b) / 9); all
   subsets of these sizes are enumerated, and sets that share one link without further checks.
   The boundary is chosen by cost, from the measured lengths of the lists that small sets would
   scan against the number of their subsets.
4. Groups of near copies: sets are grouped by STAR min-hashes, and each is compared with its
   group's pivot, the set with the least shingles of its own. Linear; what links is a component.
5. Large sets: inverted lists over the first shingles of each set. Lists of one component are
   dropped; what remains of a list meets by component and by bands of set size, and then by
   documents, each time only where enough shingles follow on both sides for a link. The few pairs
   that pass are intersected.

Shingles are told apart by 64-bit hashes and sets by 128-bit digests. Stages that are read twice are written to
the shared folder and deleted at the end. `df` must give the same rows in the same order when it
is read again, as files do.

Null or empty texts have empty sets and link with nothing, each its own component. Repeated rows
with one doc_id give one row each, and each links by its own text. Rows with a null doc_id are
kept with n_shingles and a null component. Texts of any length are one set. Other columns don't
matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches, materialize, picked, release, trimmed, without
from .components import components
from .shingles import digest, mix, sets, subsets

#: Shingles and documents of a block; bytes of a bucket and of a task's buckets, about.
BLOCK, BLOCK_DOCS, BUCKET, TASK = 1 << 19, (1 << 16) - 1, 1 << 25, 1 << 26
#: Bytes sent for a byte of text, about.
SENT = 0.4
STAR = 4
#: Sets above this size are never enumerated.
SMALL_MOST = 24
BAND = log(1.05)
_PIECES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("marks", pa.binary()), ("refs", pa.binary()), ("docs", pa.binary())])
_DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<i4"), ("k1", "<i8"), ("k2", "<i8"), ("met", "<i4")])
_MET = pa.schema([("ref", pa.int64()), ("met", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])
_MET_DDL = "ref long, met int, doc_id long, n int, k1 long, k2 long"
#: In a piece: the shingle is in more than one document of the block, which knows that already.
MANY = 0xFFFF


def overlap(a: int, b: int) -> int:
    """The least number of common shingles of linked sets of a and b."""
    return -(-4 * (a + b) // 9)


def subset_sizes(n: int) -> list[int]:
    """The subset sizes by which a set of n shingles may meet unequal sets."""
    sizes = {overlap(n, m) for m in range(-(-4 * n // 5), 5 * n // 4 + 1)}
    return sorted(c for c in sizes if c <= n and (c < n or 5 * n // 4 > n))


def wanted(n: int) -> int:
    """How many of a set's sent shingles others must have."""
    return -(-n // 10)


def sent(n: int) -> int:
    return min(n, n - -(-4 * n // 5) + wanted(n))


class _Block:
    """Sets of some documents, and what they send."""

    def __init__(self, number: int):
        self.number, self.docs, self.first, self.seen = number, [], [], set()
        self.size = 0

    def add(self, key: int | None, s: np.ndarray) -> None:
        k = digest(s)
        new = key is not None and len(s) > 0 and k not in self.seen
        self.docs.append((key is not None, key or 0, len(s), *k, 0 if new else -1))
        self.first.append(s[: sent(len(s))] if new else s[:0])
        self.size += len(self.first[-1])
        if new:
            self.seen.add(k)

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.docs) >= BLOCK_DOCS

    def pieces(self, bits: int) -> pa.RecordBatch:
        docs = np.array(self.docs, _DOC)
        marks = mix(np.concatenate(self.first) ^ np.uint64(0x5851F42D4C957F2D))
        refs = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(x) for x in self.first])
        order = np.argsort(marks)
        marks, refs = marks[order], refs[order]
        same = marks[1:] == marks[:-1]
        first, last = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
        first, last = first[: len(marks)], last[: len(marks)]
        docs["met"] += np.bincount(refs[~(first & last)], minlength=len(docs)).astype(np.int32)
        marks, refs = marks[first], np.where(last, refs, MANY)[first].astype(np.uint16)
        buckets = (marks >> np.uint64(64 - bits)).astype(np.int64)
        marks = (marks << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
        ends = [*cut[1:].tolist(), len(buckets)]
        parts = list(zip(cut.tolist(), ends, strict=False))
        columns = [
            [*buckets[cut].tolist(), self.number % (1 << bits)],
            [self.number] * (len(parts) + 1),
            [*[marks[a:b].tobytes() for a, b in parts], None],
            [*[refs[a:b].tobytes() for a, b in parts], None],
            [*[None] * len(parts), docs.tobytes()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def _sender(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        block = _Block(number)
        for batch in batches:
            for key, s in zip(batch.column(0).to_pylist(), sets(batch.column(1)), strict=True):
                block.add(key, s)
                if block.full():
                    yield block.pieces(bits)
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield block.pieces(bits)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and how many of a document's shingles a bucket has from other blocks too."""

    def met(held: list) -> Iterator[pa.RecordBatch]:
        marks = np.concatenate([np.frombuffer(m, np.uint32) for _, m, _ in held])
        refs = np.concatenate([(np.frombuffer(r, np.uint16).astype(np.int64) | (block << 16)) for block, _, r in held])
        order = np.argsort(marks)
        marks, refs = marks[order], refs[order]
        same = marks[1:] == marks[:-1]
        both = np.zeros(len(marks), bool)
        both[1:] |= same
        both[:-1] |= same
        refs, counts = np.unique(refs[both & (refs & 0xFFFF != MANY)], return_counts=True)
        nothing = [pa.nulls(len(refs), f.type) for f in _MET][2:]
        yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array(counts.astype(np.int32)), *nothing], schema=_MET)

    held, bucket = [], None
    for batch in batches:
        for at, block, marks, refs, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and at != bucket:
                yield from met(held)
                held = []
            bucket = at
            if raw is None:
                held.append((block, marks, refs))
            else:
                docs = np.frombuffer(raw, _DOC)
                ids = pa.array(docs["doc_id"], mask=docs["known"] == 0)
                counts = pa.array(docs["met"], mask=docs["met"] < 0)
                ref = np.arange(len(docs), dtype=np.int64) | (block << 16)
                yield pa.RecordBatch.from_arrays([pa.array(ref), counts, ids, *[pa.array(np.ascontiguousarray(docs[c])) for c in ("n", "k1", "k2")]], schema=_MET)
    if held:
        yield from met(held)


def sets_met(df: DataFrame) -> DataFrame:
    """A row for each row of `df`: doc_id, n, k1, k2 and `met`, the sent shingles that other sets have (null for a copy)."""
    spark = df.sparkSession
    size = SENT * (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = max(8, int(np.ceil(np.log2(1 + size / BUCKET))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / TASK))
    pieces = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_sender(bits)), "bucket int, block long, marks binary, refs binary, docs binary")
    rows = pieces.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_meet), _MET_DDL)
    return rows.groupBy("ref").agg(*[F.max(c).alias(c) for c in ("doc_id", "n", "k1", "k2")], F.sum("met").alias("met")).drop("ref")


def _tokens(df: DataFrame) -> DataFrame:
    """Rows of (k, n, tokens) of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            values = pa.array(np.concatenate(held).view(np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([digest(s)[0] for s in held], pa.int64()), pa.array([len(s) for s in held], pa.int32()), pa.ListArray.from_arrays(at, values)], names=["k", "n", "tokens"])

        held, size = [], 0
        for batch in batches:
            for s in sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return df.select("text").mapInArrow(trimmed(run), "k long, n int, tokens array<long>")


def needed(n: str | Column) -> Column:
    """The shingles that a set of n has in common with any set that it links with."""
    return F.ceil(F.col(n) * 4 / 5) if isinstance(n, str) else F.ceil(n * 4 / 5)


def shared_tokens(each: DataFrame) -> DataFrame:
    """Rows of (k, n, s, t, w): t are a set's s shingles that other sets have too, the rarest first; w is the length of its lists.

    Sets without enough of them to link are left out.
    """
    flat = each.select("k", F.explode("tokens").alias("tok"))
    counts = flat.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    listed = flat.join(counts, "tok").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("ct"))
    listed = listed.join(each.select("k", "n"), "k").where(F.size("ct") >= needed("n"))
    first = F.slice("ct", 1, (F.size("ct") - needed("n") + 1).cast("int"))
    return listed.select("k", "n", F.size("ct").alias("s"), F.transform("ct", lambda x: x.tok).alias("t"), F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + x.c).alias("w"))


def boundary(shared: DataFrame) -> int:
    """The size up to which enumerating all sets' subsets costs no more than scanning their lists."""
    rows = shared.where(F.col("n") <= SMALL_MOST).groupBy("n").agg(F.count("*").alias("docs"), F.sum("w").alias("lists")).collect()
    by, best, enumerated, scanned = {r.n: r for r in rows}, 0, 0, 0
    for n in range(1, SMALL_MOST + 1):
        if n in by:
            enumerated += by[n].docs * sum(comb(n, c) for c in subset_sizes(n))
            scanned += by[n].lists
        if enumerated <= scanned:
            best = n
    return best


def small_links(shared: DataFrame, most: int) -> DataFrame:
    """Links by subsets among sets of `most` shingles or fewer.

    Of the sets that share a subset of c, one links by it with another only if it does with the
    smallest, as overlap() grows with both sizes: links with the smallest keep all components.
    """

    def run(keys, sizes, tokens):
        out = [(k, n, c, x) for k, n, t in zip(keys, sizes, tokens, strict=True) for c in subset_sizes(n) if c <= len(t) for x in subsets(t, c)]
        return [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]

    def signed(keys, sizes, tokens):
        k, n, c, x = run(keys, sizes, tokens)
        return [k, n, c, np.array(x, np.uint64).view(np.int64)]

    filed = map_batches(shared.where(F.col("n") <= most).select("k", "n", "t"), "k long, n int, c int, x long", signed)
    least = filed.groupBy("c", "x").agg(F.min(F.struct("n", "k")).alias("p"), F.count("*").alias("many")).where("many > 1").select("c", "x", "p")
    return filed.join(least, ["c", "x"]).where("k <> p.k and 9 * c >= 4 * (n + p.n)").select(F.col("k").alias("a"), F.col("p.k").alias("b")).distinct()


def star_pairs(shared: DataFrame) -> DataFrame:
    """Every set with the pivot of each of its min-hash groups, where the two can link."""
    def least(i: int) -> Column:
        return F.struct(F.lit(i).alias("i"), F.array_min(F.transform("t", lambda x: F.xxhash64(x, F.lit(i)))).alias("h"))

    keyed = shared.select("k", "n", "s", F.explode(F.array(*map(least, range(STAR)))).alias("g")).select("k", "n", "s", "g.i", "g.h")
    pivots = keyed.groupBy("i", "h").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "k", "n", "s")).alias("p"), F.count("*").alias("many")).where("many > 1").select("i", "h", "p")
    near = keyed.join(pivots, ["i", "h"]).where("k <> p.k and 9 * least(s, p.s) >= 4 * (n + p.n)")
    return near.select(F.col("k").alias("a"), F.col("p.k").alias("b")).distinct()


def linked(shared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link: 100 * both >= 80 * (na + nb - both)."""
    a = shared.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"))
    b = shared.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def list_pairs(shared: DataFrame, comps: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) across components that may link by lists, and what to release after them.

    A set is filed under its first s - ceil(0.8 n) + 1 shingles. In a pair the smaller set asks, by
    size bands; two sets can link by a shingle only where overlap() shingles are left on both sides.
    """
    named = shared.join(comps.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("comp", F.coalesce("component", "k"))
    first = F.slice("t", 1, (F.col("s") - needed("n") + 1).cast("int"))
    filed = named.where(5 * F.col("n") >= 4 * (most + 1)).select("k", "n", "s", "comp", F.posexplode(first).alias("pos", "tok")).select("k", "n", "comp", "tok", (F.col("s") - F.col("pos")).alias("rest"))
    filed = materialize(filed, "filed")
    mixed = filed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
    filed_mixed = materialize(filed.join(mixed, "tok", "left_semi"), "mixed")
    band = lambda n: F.floor(F.log(n) / BAND).cast("int")
    held = filed_mixed.where(F.col("n") > most).withColumn("band", band(F.col("n")))
    asked = filed_mixed.withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.floor(F.col("n") * 5 / 4)))))
    least = F.greatest(F.col("n"), F.floor(F.exp(F.col("band") * BAND)) - 1)
    asked = asked.where(9 * F.col("rest") >= 4 * (F.col("n") + least))
    of = lambda df, at: df.groupBy("tok", "band", F.col("comp").alias(at)).agg(F.max("rest").alias(f"rest_{at}"), F.min("n").alias(f"n_{at}"), F.count("*").alias(f"many_{at}"))
    meet = of(asked, "x").join(of(held, "y"), ["tok", "band"]).where("x <> y and 9 * least(rest_x, rest_y) >= 4 * (n_x + n_y)")
    meet = materialize(meet, "meet")

    def side(df: DataFrame, at: str, name: str) -> DataFrame:
        return df.select("tok", "band", F.col("comp").alias(at), F.col("k").alias(name), F.col("n").alias(f"n{name}"), F.col("rest").alias(f"r{name}"))

    a, b = side(asked, "x", "a"), side(held, "y", "b")
    # the side with fewer documents is written out first
    few_a = meet.where("many_x <= many_y").join(a, ["tok", "band", "x"]).where("9 * least(ra, rest_y) >= 4 * (na + n_y)").join(b, ["tok", "band", "y"])
    few_b = meet.where("many_x > many_y").join(b, ["tok", "band", "y"]).where("9 * least(rb, rest_x) >= 4 * (nb + n_x)").join(a, ["tok", "band", "x"])
    columns = ["a", "na", "ra", "b", "nb", "rb"]
    pairs = few_a.select(columns).union(few_b.select(columns)).where("(na < nb or na = nb and a < b) and 9 * least(ra, rb) >= 4 * (na + nb)")
    return pairs.select("a", "b").distinct(), [filed, filed_mixed, meet]


def classes(df: DataFrame, small: int | None = None) -> DataFrame:
    """Rows of (doc_id, n_shingles, class_id, component_id, k1, k2, component_key), one for each row of `df`.

    k1 and k2 are the digest of a row's set; class_id is the least doc_id with that digest, and
    component_id the least that is reachable by links. component_key tells components apart even
    where one doc_id has texts in several. `small` fixes the boundary of small sets.
    """
    df = df.select("doc_id", "text")
    rows = materialize(sets_met(df), "sets")
    full = rows.where("n > 0 and doc_id is not null")
    reps = materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.max("met").alias("met"), F.max("n").alias("n")), "classes")
    left = reps.where(F.col("met") >= F.ceil(F.col("n") / 10)).select(F.col("class_id").alias("doc_id"))
    each = materialize(_tokens(picked(df, left)), "tokens")
    kept = [each]
    if each.count() > left.count():  # repeated ids
        each = materialize(each.dropDuplicates(["k"]), "tokens")
        kept.append(each)
    shared = materialize(shared_tokens(each), "shared")
    most = boundary(shared) if small is None else small
    near = materialize(star_pairs(shared), "pairs")
    links = linked(shared, near)
    if most:
        links = links.union(small_links(shared, most))
    links = materialize(links, "links")
    comps = components(links)
    pairs, more = list_pairs(shared, comps, most)
    pairs = materialize(pairs, "pairs")
    further = materialize(linked(shared, pairs), "links")
    kept += [near, links, comps, pairs, further, shared, *more]
    if not further.isEmpty():
        comps = components(links.union(further))
        kept.append(comps)
    found = reps.join(comps, reps.k1 == comps.node, "left")
    least = found.where("component is not null").groupBy("component").agg(F.min("class_id").alias("component_id"))
    grouped = found.join(least, "component").select("k1", "k2", "class_id", "component_id", F.col("component").alias("component_key"))
    alone = found.where("component is null").select("k1", "k2", "class_id", F.col("class_id").alias("component_id"), F.col("k1").alias("component_key"))
    named = grouped.union(alone)
    named = materialize(named, "named")
    release(reps, *kept)
    return _labelled(rows, named)


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id", "k1", "k2", "component_key"]
    single = rows.where(alone).withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id"), "component_key": F.lit(None).cast("long")})
    return rows.where(~alone).join(named, ["k1", "k2"]).select(columns).union(single.select(columns))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """Whole rows of `docs`: of each group of linked texts the one with the least doc_id.

    Rows are told apart by doc_id and text, so a text of a repeated doc_id stays if its own group
    chose it; of rows with one doc_id and equal sets one stays, the first by its columns as JSON.
    Rows without words or without a doc_id link with nothing and stay.
    """
    found = materialize(classes(docs).select("doc_id", "n_shingles", "k1", "k2", "component_key"), "groups")
    texts = found.where("component_key is not null")
    first = materialize(texts.groupBy("component_key").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f")).select("f.*"), "first")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    gone = texts.join(first, ["doc_id", "k1", "k2"], "left_anti").select("doc_id")
    if again.isEmpty():
        return without(docs, gone)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(*digest(s), len(s)) for s in sets(batch.column("text"))]
            k1, k2, n = ([k[i] for k in keys] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), batch.column("row")], names=["doc_id", "k1", "k2", "n", "row"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = picked(docs, again).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("row", packed.schema["row"].dataType)])
    repeated = materialize(packed.mapInArrow(trimmed(keyed), kind), "repeated")
    one = repeated.where("n > 0").join(first, ["doc_id", "k1", "k2"], "left_semi").groupBy("doc_id", "k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    kept = repeated.where("n = 0").select("row").union(one.select("row")).select("row.*")
    return without(docs, gone.union(again)).unionByName(kept)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")
