"""JSON import and export, table counts, verified copies and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import MEMORIES

#: What an import may hold.
MOST_BYTES, MOST_ROWS = 8 * 1024 * 1024, 10_000


def read_json(spark: SparkSession, path: str, schema=MEMORIES) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a path, by whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen()))
    return out


def read_import(spark: SparkSession, path: str, within: str, schema=MEMORIES, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of a JSON import. Refused with ValueError: paths outside `within`, other files than .json, too many bytes or rows."""
    if ".." in path or not path.startswith(within.rstrip("/") + "/"):
        raise ValueError("an import lies in its own folder")
    files = [(f, n) for f, n in _files(spark, path) if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
    if any(not f.endswith(".json") for f, _ in files):
        raise ValueError("an import is .json")
    if sum(n for _, n in files) > most_bytes:
        raise ValueError(f"an import has at most {most_bytes} bytes")
    rows = spark.read.schema(schema).json(path)
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"an import has at most {most_rows} rows")
    return rows


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def verified_copy(df: DataFrame, path: str) -> bool:
    """Write Parquet and compare row count and an order-free hash with the source."""
    df.write.mode("overwrite").parquet(path)
    seal = [F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in df.columns)}))").alias("h")]
    return df.agg(*seal).first() == df.sparkSession.read.schema(df.schema).parquet(path).agg(*seal).first()


def snapshot(tables: dict[str, DataFrame], folder: str, name: str, keep: int = 5) -> list[str]:
    """Write all tables to a staging folder, verify each, and only then give the snapshot its name; the `keep` last names stay.

    Names are compared as text, so let them begin with a time. Returns the names that are there.
    """
    spark = next(iter(tables.values())).sparkSession
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    fs = path(name).getFileSystem(spark._jsc.hadoopConfiguration())
    for table, df in tables.items():
        if not verified_copy(df, f"{folder}/.staging-{name}/{table}"):
            fs.delete(path(f".staging-{name}"), True)
            raise ValueError(f"the copy of {table} differs")
    if not fs.rename(path(f".staging-{name}"), path(name)):
        raise ValueError(f"{name} is there already")
    names = sorted(s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)) if not s.getPath().getName().startswith("."))
    for old in names[: max(0, len(names) - keep)]:
        fs.delete(path(old), True)
    return names[-keep:]
