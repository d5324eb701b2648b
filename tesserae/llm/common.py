"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times inside `body`.

    Catalyst may paste an expression into each place that uses it; a lambda variable over a
    one-element array can't be pasted.
    """
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/tesserae-checkpoints"
    return top


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """While it lasts, Arrow batches of a few MB: a batch is held on both sides of a Python worker's pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Lower the session's bound on Arrow batches, where it is higher, for rows that the caller computes later."""
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < size(spark.conf.get(key)) <= size(most):
        spark.conf.set(key, most)


def trim() -> None:
    """Give freed memory back: workers live on after a task, and the next stages need what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], last: Callable[[], None] | None = None) -> Callable:
    """A function for mapInArrow that calls `last` and trims the worker when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if last is not None:
                last()
            trim()

    return whole


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet to the shared folder and read it back.

    Lost executors lose none of it, and every later reader sees the same rows. `release` deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing that is still to run reads it."""
    for df in written:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _parts(batch: pa.RecordBatch, rows: int = 1024, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of limited rows and bytes, one row at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_batches(df: DataFrame, schema: str, fn: Callable[..., list], *args, last: Callable[[], None] | None = None) -> DataFrame:
    """Apply `fn(columns as lists, *args) -> list of result columns` to Arrow batches, cut to a few MB of text; `last` ends each task."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                out = fn(*[c.to_pylist() for c in part.columns], *args)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return df.mapInArrow(trimmed(run, last), schema)


def map_whole(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply `fn` to Arrow batches of whole rows that it returns with the same columns, changed or fewer.

    Columns that `fn` doesn't touch stay Arrow data, whatever their names and types.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield fn(part)

    return df.mapInArrow(trimmed(run), df.schema)


#: Ids that are broadcast at most (8 bytes each) to pick or drop rows; beyond, a bitmap of at most
#: BITMAP words (16 bytes each) sorts out most rows before the rest are joined by shuffle.
IDS_MOST, BITMAP = 500_000, 1 << 20


def _bitmap(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What joins a broadcast bitmap of hashed ids to rows, as a column `bits_` that is 0 where no id can match."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP * 64))
    bit = F.expr("shiftleft(1L, cast(place_ % 64 as int))")
    words = ids.select(place.alias("place_")).groupBy(F.expr("cast(place_ div 64 as int)").alias("word_")).agg(F.bit_or(bit).alias("set_"))
    words = materialize(words, "bitmap")

    def joined(df: DataFrame) -> DataFrame:
        df = df.withColumn("place_", place).withColumn("word_", F.expr("cast(place_ div 64 as int)"))
        return df.join(F.broadcast(words), "word_", "left").withColumn("bits_", F.coalesce(F.col("set_").bitwiseAND(bit), F.lit(0)))

    return joined


def picked(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of `df` whose doc_id is in `ids`, without moving most of `df`."""
    ids = materialize(ids.distinct(), "ids")
    if ids.count() <= IDS_MOST:
        return df.join(F.broadcast(ids), "doc_id", how).select(*df.columns)
    marked = _bitmap(ids)(df.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_")))
    found = marked.where("bits_ <> 0").join(ids, "doc_id", how).select("row_.*")
    return found if how == "left_semi" else marked.where("bits_ = 0").select("row_.*").unionByName(found)


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    return picked(df, ids, "left_anti")
