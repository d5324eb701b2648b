"""Rank fusion, rescoring, hybrid retrieval and budgeted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tesserae.functions import scope, scoring
from tesserae.operators import lexical, vectors
from tesserae.sources.shared import written


def fuse(*channels: DataFrame, k: int = scoring.RRF_K) -> DataFrame:
    """Rows of (id, rrf, rank_0, rank_1, ...) from channels of (id, rank)."""
    parts = [c.select("id", F.lit(i).alias("channel"), "rank") for i, c in enumerate(channels)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    ranks = [F.max(F.when(F.col("channel") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(channels))]
    return union.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), *ranks)


def retrieve(memories: DataFrame, embeddings: DataFrame, query: str, vector: list[float], now: Column, limit: int = 10, mode: str = "rrf", include_archived: bool = False, **who) -> DataFrame:
    """The best visible memories for a query text and its vector; modes rrf, fts-only and vector-only."""
    limit = max(1, min(limit, 50))
    allowed = scope.visible(**who) & scope.not_hidden(include_archived)
    words = lexical.search(memories, query, 50, visible=allowed).select("id", "rank")
    near = vectors.search(embeddings, vector, 50, visible=memories.where(allowed))
    near = near.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("id", "rank")
    fused = fuse(words.limit(0) if mode == "vector-only" else words, near.limit(0) if mode == "fts-only" else near)
    rows = memories.join(F.broadcast(fused), "id")  # at most 100 rows
    score = scoring.final_score(F.col("rrf"), F.col("confidence"), F.col("importance"), scoring.recency(F.col("type"), F.col("updated_at"), now), scoring.scope_factor(**who))
    rows = rows.withColumn("final_score", F.round(score, 8))
    return rows.orderBy(F.desc("final_score"), F.asc_nulls_last("rank_0"), F.asc_nulls_last("rank_1"), "id").limit(limit)


def retrieve_many(memories: DataFrame, embeddings: DataFrame, queries: DataFrame, now: Column, limit: int = 10, texts: DataFrame | None = None, **who) -> DataFrame:
    """Rows of (qid, id, final_score, place): `retrieve` for many queries (qid, query, vec) in one plan; `texts` as in lexical.search_many."""
    limit = max(1, min(limit, 50))
    allowed = scope.visible(**who) & scope.not_hidden()
    words = lexical.search_many(memories, queries.select("qid", "query"), 50, visible=allowed, texts=texts).select("qid", "id", "rank", F.lit(0).alias("channel"))
    near = vectors.search_many(embeddings, queries.select("qid", "vec"), 50, visible=memories.where(allowed)).select("qid", "id", "rank", F.lit(1).alias("channel"))
    ranks = [F.max(F.when(F.col("channel") == i, F.col("rank"))).alias(f"rank_{i}") for i in (0, 1)]
    fused = words.unionByName(near).groupBy("qid", "id").agg(F.sum(1.0 / (scoring.RRF_K + F.col("rank"))).alias("rrf"), *ranks)
    score = scoring.final_score(F.col("rrf"), F.col("confidence"), F.col("importance"), scoring.recency(F.col("type"), F.col("updated_at"), now), scoring.scope_factor(**who))
    rows = memories.select("id", "type", "scope", "user_id", "session_id", "project_id", "confidence", "importance", "updated_at").join(fused, "id").withColumn("final_score", F.round(score, 8))
    by = W.partitionBy("qid").orderBy(F.desc("final_score"), F.asc_nulls_last("rank_0"), F.asc_nulls_last("rank_1"), "id")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("qid", "id", "final_score", "place")


def budget(rows: DataFrame, order: list, most: int, body: str = "content") -> DataFrame:
    """The prefix of ranked rows within a token budget; the first row always stays.

    A row costs eight tokens or more, so no more than `most` / 8 rows can fit: a top-k before the running sum.
    """
    by = W.orderBy(*order)
    rows = rows.orderBy(*order).limit(most // 8 + 1).withColumn("tokens", scoring.token_estimate(F.col(body))).withColumn("position", F.row_number().over(by))
    rows = rows.withColumn("used", F.sum("tokens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where((F.col("position") == 1) | (F.col("used") <= most))


def truncated(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: how many rows there were, how many the budget kept, and whether it cut any."""
    n = rows.agg(F.count("*").alias("rows")).join(kept.agg(F.count("*").alias("kept")))  # one row each
    return n.select("rows", "kept", (F.col("rows") > F.col("kept")).alias("truncated"))


def context(memories: DataFrame, links: DataFrame, seeds: DataFrame, at: Column, most: int) -> DataFrame:
    """Seeds and the memories they link to, valid and visible, in order, within the budget."""
    seeds = written(seeds.select("id", F.col("final_score").alias("score")), "seeds")  # at most 50 rows, used three times
    next_ids = links.join(F.broadcast(seeds.select(F.col("id").alias("source_memory_id"))), "source_memory_id").select(F.col("target_memory_id").alias("id")).distinct()
    next_ids = next_ids.join(F.broadcast(seeds.select("id")), "id", "left_anti").select("id", F.lit(0.0).alias("score"), F.lit(1).alias("hop"))
    rows = memories.join(seeds.withColumn("hop", F.lit(0)).unionByName(next_ids), "id").where(scope.not_hidden() & scope.valid_at(at))
    return budget(rows, ["hop", F.desc("score"), "id"], most)
