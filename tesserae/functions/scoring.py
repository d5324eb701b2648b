"""Scores: recency, scope, salience, confidence, BM25, likeness of sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
K1, B = 1.2, 0.75
#: The daily decay by type.
DECAY = {"CONSTRAINT": 0.0005, "DECISION": 0.001, "LESSON": 0.001, "PREFERENCE": 0.001, "FACT": 0.005, "PROCEDURE": 0.005, "RELATION": 0.005, "GOAL": 0.01, "EPISODE": 0.01, "PROFILE": 0.0, "DERIVED": 0.002}
DECAY_OTHER = 0.005
#: The weight of a source, and of the parts of salience.
SOURCE = {"explicit": 1.0, "corrected": 0.95, "system": 0.8, "consolidated": 0.75, "imported": 0.7, "inferred": 0.5, "captured": 0.3}
SOURCE_OTHER = 0.5
SALIENCE = {"relevance": 0.3, "importance": 0.2, "confidence": 0.15, "recency": 0.15, "frequency": 0.1, "project": 0.1}


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _lookup(key: Column, table: dict, other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 8.64e10)


def recency(kind: Column, at: Column, now: Column) -> Column:
    return F.exp(-_lookup(kind, DECAY, DECAY_OTHER) * F.coalesce(age_days(at, now), F.lit(0.0)))


def scope_factor(user_id=None, session_id=None, project_id=None) -> Column:
    scope = F.col("scope")
    if session_id is not None:
        return F.when((scope == "SESSION") & (F.col("session_id") == session_id), 1.0).when(scope.isin("PROJECT", "USER"), 0.8).when(scope == "GLOBAL", 0.6).otherwise(0.2)
    if project_id is not None:
        return F.when((scope == "PROJECT") & (F.col("project_id") == project_id), 1.0).when(scope == "USER", 0.8).when(scope == "GLOBAL", 0.7).otherwise(0.3)
    if user_id is not None:
        return F.when(scope == "USER", 1.0).when(scope == "GLOBAL", 0.7).otherwise(0.3)
    return F.when(scope == "GLOBAL", 0.8).when(scope == "PROJECT", 0.7).when(scope == "USER", 0.6).otherwise(0.4)


def final_score(rrf: Column, confidence: Column, importance: Column, recent: Column, scope: Column) -> Column:
    return rrf * clamp01(confidence) * (0.5 + 0.5 * clamp01(importance)) * clamp01(recent) * clamp01(scope)


def salience(weights: dict | None = None, **parts: Column) -> Column:
    weights = {**SALIENCE, **(weights or {})}
    return clamp01(sum((w * clamp01(parts[k]) for k, w in weights.items()), F.lit(0.0)))


def confidence(source: Column, confirmations: Column) -> Column:
    w = _lookup(source, SOURCE, SOURCE_OTHER)
    return w + (1 - w) * (1 - 1 / (1 + confirmations))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4) + 8


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bm25(tf: Column, length: Column, mean: Column, documents: Column, df: Column) -> Column:
    raw = F.ln((documents - df + 0.5) / (df + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
