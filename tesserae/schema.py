"""Closed vocabularies and explicit schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: The vocabularies of the data model.
MEMORY_TYPES = "FACT PREFERENCE GOAL DECISION CONSTRAINT LESSON PROCEDURE EPISODE RELATION PROFILE DERIVED".split()
SOURCE_TYPES = "explicit corrected inferred captured consolidated imported system".split()
STATES = "new active reinforced stale superseded archived deleted".split()
HIDDEN = ("deleted", "archived", "superseded")
SCOPES = "GLOBAL USER PROJECT SESSION".split()
LINKS = "supports contradicts supersedes derived_from related_to caused_by depends_on".split()
KIND_LIMITS = {"prompt": 4000, "tool_call": 500, "error": 500}
ROLES = {"reader": 0, "writer": 1, "owner": 2, "admin": 3}
TRANSITIONS = {
    "new": ["active", "deleted"],
    "active": ["reinforced", "stale", "superseded", "archived", "deleted"],
    "reinforced": ["active", "stale", "superseded", "archived", "deleted"],
    "stale": ["active", "archived", "deleted"],
    "superseded": ["archived", "deleted"],
    "archived": ["deleted"],
    "deleted": [],
}


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
MEMORIES = _struct(id=_L, type=_S, content=_S, summary=_S, status=_S, source=_S, confidence=_D, importance=_D, salience=_D, project_id=_S, session_id=_S, user_id=_L, scope=_S, created_at=_TS, updated_at=_TS, last_accessed_at=_TS, access_count=_L, valid_from=_TS, valid_until=_TS, supersedes_id=_L, metadata=_S)
INTERACTIONS = _struct(id=_L, ts=_TS, session_id=_S, kind=_S, content=_S, meta=_S, user_id=_L)
PREFERENCES = _struct(id=_L, category=_S, key=_S, value=_S, confidence=_D, source=_S, updated_at=_TS, user_id=_L)
LESSONS = _struct(id=_L, situation=_S, mistake=_S, correction=_S, created_at=_TS, user_id=_L)
MEMORY_LINKS = _struct(source_memory_id=_L, relation=_S, target_memory_id=_L, confidence=_D, created_at=_TS)
EVENTS = _struct(event_id=_L, ts=T.TimestampType(), user_id=_L, event_type=_S, value=_D, props=_S)
