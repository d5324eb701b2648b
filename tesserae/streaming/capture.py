"""Event capture as Structured Streaming: project, redact, truncate, drop repeats, enrich, append, distill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text
from tesserae.schema import EVENTS, KIND_LIMITS

#: One JSON event for each call of a command-line hook.
HOOK = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "session_id", "hook_event_name", "prompt", "tool_name", "tool_response")] + [T.StructField("ts", T.TimestampType())])


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events in a folder of Parquet files, as a stream."""
    return spark.readStream.schema(EVENTS).parquet(path)


def hooks(spark: SparkSession, path: str) -> DataFrame:
    """The hook events in a folder of JSON files, as a stream."""
    return spark.readStream.schema(HOOK).json(path)


def _limited(kind: Column, content: Column) -> Column:
    """Redacted before truncated, so that no cut secret survives."""
    limits = F.create_map(*[F.lit(x) for kv in KIND_LIMITS.items() for x in kv])
    return text.truncate(text.redact(content), F.try_element_at(limits, kind))


def captured(rows: DataFrame) -> DataFrame:
    """Events as interactions."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("click", "view"), "prompt").otherwise("tool_call")
    rows = rows.withColumn("kind", kind)
    return rows.select(F.col("event_id").alias("id"), "ts", "user_id", "kind", _limited(F.col("kind"), F.col("props")).alias("content"))


def hooked(rows: DataFrame) -> DataFrame:
    """Hook events as interactions: prompts that aren't blank, and tool calls with their status in `meta`."""
    kind = F.when(F.col("hook_event_name") == "UserPromptSubmit", "prompt").when(F.col("hook_event_name") == "PostToolUse", "tool_call")
    tool = F.coalesce("tool_name", F.lit(""))
    content = F.when(F.col("kind") == "prompt", F.col("prompt")).otherwise(F.concat(F.lit("tool="), tool))
    meta = F.when(F.col("kind") == "tool_call", F.to_json(F.struct(tool.alias("tool"), text.error_status(F.coalesce("tool_response", F.lit(""))).alias("status"))))
    out = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("raw", content).where(F.length(F.trim("raw")) > 0)
    return out.select("id", "ts", "session_id", "kind", _limited(F.col("kind"), F.col("raw")).alias("content"), meta.alias("meta"))


def distinct_events(rows: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """Repeats of (kind, content, user) within the delay are dropped; state is bounded by the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["kind", "content", "user_id"])


def distinct_ids(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events that come again with an id seen within the delay are dropped."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def first_seen(rows: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Rows whose id isn't among the last `most` new ids of their key: a bounded first-in, first-out memory for each key."""
    import pandas as pd

    names, at = rows.columns, rows.columns.index("id")

    def step(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known = set(seen)
        for pdf in batches:
            keep = []
            for value in pdf.iloc[:, at]:
                new = str(value) not in known
                keep.append(new)
                if new:
                    seen.append(str(value))
                    known.add(str(value))
                    if len(seen) > most:
                        known.discard(seen.pop(0))
            yield pdf.loc[keep, names]
        state.update((seen,))

    memory = T.StructType([T.StructField("seen", T.ArrayType(T.StringType()))])
    return rows.groupBy(key).applyInPandasWithState(step, rows.schema, memory, "append", "NoTimeout")


def enriched(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Prompts and compactions with the profile text of their user (user_id, profile), a static table; without one, null."""
    asked = rows.where(F.col("kind").isin("prompt", "compact"))
    return asked.join(profiles, "user_id", "left").withColumnRenamed("profile", "additional_context")


def append(rows: DataFrame, path: str, checkpoint: str):
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_session_end(rows: DataFrame, distill: Callable[[DataFrame, int], None], checkpoint: str):
    """Call `distill` with the sessions that a batch ends and the batch's number; a batch that is run again has the same number."""

    def batch(df: DataFrame, number: int) -> None:
        ended = df.where("hook_event_name = 'SessionEnd'").select("session_id").distinct()
        if not ended.isEmpty():
            distill(ended, number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
