"""The data model's tables as views over the given tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.schema import LINKS, MEMORY_TYPES, SCOPES, SOURCE_TYPES

NOW = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str]) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").selectExpr(
        "doc_id AS id",
        f"element_at({_pick(MEMORY_TYPES)}, CAST(doc_id % 11 + 1 AS INT)) AS type",
        "text AS content",
        "CASE WHEN toxic THEN 'archived' WHEN doc_id % 13 = 0 THEN 'stale' ELSE 'active' END AS status",
        f"element_at({_pick(SOURCE_TYPES)}, CAST(doc_id % 7 + 1 AS INT)) AS source",
        "(doc_id % 10 + 1) / 10.0D AS confidence",
        "(doc_id * 3 % 10 + 1) / 10.0D AS importance",
        f"element_at({_pick(SCOPES)}, CAST(doc_id % 4 + 1 AS INT)) AS scope",
        "CASE WHEN doc_id % 4 = 1 THEN doc_id % 3 + 1 END AS user_id",
        "CASE WHEN doc_id % 4 = 2 THEN concat('p', doc_id % 5) END AS project_id",
        "CASE WHEN doc_id % 4 = 3 THEN concat('s', doc_id % 7) END AS session_id",
        "timestampadd(DAY, CAST(doc_id % 365 AS INT), TIMESTAMP '2024-01-01 00:00:00') AS updated_at",
        "CASE WHEN doc_id % 3 = 0 THEN timestampadd(DAY, CAST(doc_id % 200 AS INT), TIMESTAMP '2024-01-01 00:00:00') END AS valid_from",
        "CASE WHEN doc_id % 5 = 0 THEN timestampadd(DAY, CAST(doc_id % 400 AS INT), TIMESTAMP '2024-02-01 00:00:00') END AS valid_until",
        "CASE WHEN doc_id % 6 = 5 THEN doc_id - 1 END AS supersedes_id",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type and content of the memories, read without the labels."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"element_at({_pick(MEMORY_TYPES)}, CAST(doc_id % 11 + 1 AS INT)) AS type", "text AS content")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn AS id", "concat('c', conv_id) AS session_id",
        "CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'tool_call' ELSE 'error' END AS kind", "text AS content",
        "timestampadd(MINUTE, CAST(conv_id * 60 + turn AS INT), TIMESTAMP '2024-01-01 00:00:00') AS ts",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document points at the one whose id is (7 id + 3) modulo the greatest id + 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))
    return docs.crossJoin(F.broadcast(n)).selectExpr("doc_id AS source_memory_id", f"element_at({_pick(LINKS)}, CAST(doc_id % 7 + 1 AS INT)) AS relation", "(doc_id * 7 + 3) % n AS target_memory_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vec")


#: Further tables, each as (Spark expressions, SQL expressions, base table); where there is one list it holds for both.
_MORE = {
    "users": ("customer", "c_custkey AS id; concat('u', c_custkey) AS external_id; c_name AS name; CASE c_custkey % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' WHEN 2 THEN 'owner' ELSE 'admin' END AS role"),
    "grants": (
        "customer",
        "c_custkey % 50 AS grantee_user_id; CASE c_custkey % 4 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'USER' WHEN 2 THEN 'PROJECT' ELSE 'SESSION' END AS scope_kind;"
        "CASE c_custkey % 4 WHEN 0 THEN '*' WHEN 1 THEN concat('u', c_custkey % 7) WHEN 2 THEN concat('p', c_custkey % 5) ELSE concat('s', c_custkey % 7) END AS scope_ref;"
        "CASE WHEN c_custkey % 3 = 0 THEN 'write' ELSE 'read' END AS permission",
    ),
    "preferences": (
        "part",
        "p_partkey AS id; CASE p_partkey % 5 WHEN 0 THEN 'work_style' WHEN 1 THEN 'coding_pref' WHEN 2 THEN 'language' WHEN 3 THEN 'domain' ELSE 'other' END AS category; p_name AS key; p_brand AS value;"
        "CAST(p_size % 10 + 1 AS DOUBLE) / 10 AS confidence; CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 END AS user_id",
    ),
    "lessons": (
        "orders",
        "o_orderkey AS id; concat('order of ', o_orderpriority) AS situation; concat('status ', o_orderstatus) AS mistake; concat('check customer ', CAST(o_custkey AS STRING)) AS correction;"
        "o_orderdate AS created_at; CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 END AS user_id",
    ),
    "entities": ("part", "p_partkey AS id; p_name AS name; lower(trim(p_name)) AS canonical_name; p_type AS type"),
    "relations": (
        "events",
        "event_id AS id; event_id * 7 % 500 AS source_entity_id; event_type AS relation; event_id * 11 % 400 AS target_entity_id; CASE WHEN event_id % 4 > 0 THEN event_id % 300 END AS source_memory_id",
    ),
    "tokens": ("supplier", "s_suppkey AS id; s_suppkey * 3 % 150 AS user_id; concat('thm_', s_name) AS token; s_suppkey % 5 = 0 AS revoked"),
    "audit": ("events", "event_id AS id; ts; user_id AS actor; event_type AS action"),
    "captured": (
        "conversations",
        "conv_id * 100 + turn AS id; concat('c', conv_id % 40) AS session_id; CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'tool_call' ELSE 'error' END AS kind; text AS content;"
        "CASE WHEN conv_id % 3 > 0 THEN conv_id % 50 END AS user_id;"
        "CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 11 = 1 THEN 'not json' WHEN conv_id % 11 = 2 THEN '[1]' WHEN conv_id % 11 = 3 THEN '{\"tool\":7,\"directory\":\"  \"}'"
        " ELSE concat('{\"tool\":\" t', conv_id % 17, '\",\"directory\":\"/d', turn % 7, '\"}') END AS meta",
    ),
}


def more(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the further tables: users, grants, preferences, lessons, entities, relations, tokens, audit, captured."""
    base, columns = _MORE[name]
    return table(spark, sf_dir, base).selectExpr(*[c.strip() for c in columns.split(";")])


def more_sql(*names: str) -> str:
    """The same tables as common table expressions, each after a comma."""
    return "".join(f", {n} AS (SELECT {_MORE[n][1].replace(';', ', ')} FROM {_MORE[n][0]})" for n in names)


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


#: The same views as common table expressions.
SQL = f"""
memories AS (
  SELECT d.doc_id AS id, ({_list(MEMORY_TYPES)})[d.doc_id % 11 + 1] AS type, d.text AS content,
    CASE WHEN l.doc_id IS NOT NULL THEN 'archived' WHEN d.doc_id % 13 = 0 THEN 'stale' ELSE 'active' END AS status,
    ({_list(SOURCE_TYPES)})[d.doc_id % 7 + 1] AS source,
    CAST(d.doc_id % 10 + 1 AS DOUBLE) / 10.0 AS confidence, CAST(d.doc_id * 3 % 10 + 1 AS DOUBLE) / 10.0 AS importance,
    ({_list(SCOPES)})[d.doc_id % 4 + 1] AS scope,
    CASE WHEN d.doc_id % 4 = 1 THEN d.doc_id % 3 + 1 END AS user_id,
    CASE WHEN d.doc_id % 4 = 2 THEN 'p' || (d.doc_id % 5) END AS project_id,
    CASE WHEN d.doc_id % 4 = 3 THEN 's' || (d.doc_id % 7) END AS session_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 365 AS INTEGER)) AS updated_at,
    CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 200 AS INTEGER)) END AS valid_from,
    CASE WHEN d.doc_id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + to_days(CAST(d.doc_id % 400 AS INTEGER)) END AS valid_until,
    CASE WHEN d.doc_id % 6 = 5 THEN d.doc_id - 1 END AS supersedes_id
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id),
interactions AS (
  SELECT conv_id * 100 + turn AS id, 'c' || conv_id AS session_id,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'tool_call' ELSE 'error' END AS kind, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS ts FROM conversations),
links AS (
  SELECT doc_id AS source_memory_id, ({_list(LINKS)})[doc_id % 7 + 1] AS relation,
    (doc_id * 7 + 3) % (SELECT max(doc_id) + 1 FROM documents) AS target_memory_id FROM documents)
"""
