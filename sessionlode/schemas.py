"""Schemas of the source tables and of the index."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType()), "array<bigint>": T.ArrayType(T.LongType())}


def _schema(columns: str) -> T.StructType:
    """Names and types, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


PROJECT = _schema("id string, worktree string, vcs string, name string")
SESSION = _schema("id string, project_id string, slug string, directory string, title string, version string, agent string, model string, time_created bigint, time_updated bigint, time_archived bigint")
MESSAGE = _schema("id string, session_id string, time_created bigint, time_updated bigint, data string")
#: ord stands for the order of insertion.
PART = _schema("id string, message_id string, session_id string, time_created bigint, time_updated bigint, data string, ord bigint")

CHUNK = _schema(
    "id string, session_id string, project_id string, project_path string, message_id string, msg_role string, part_type string, tool string, command string, content string, snippet string, "
    "files array<string>, position int, time_created bigint, time_updated bigint, truncated boolean, embed_text string, stemmed string, embedded boolean"
)
SESSION_META = _schema("id string, project_id string, project_path string, title string, agent string, model string, time_created bigint, time_updated bigint, compacted boolean, tail_start_id string, parts_count bigint, chunks_count bigint")
SYNC_STATE = _schema("session_id string, status string, last_time_updated bigint, time_processed bigint, error string")
#: State as it is kept: with a session's chunks and, by source of postings, terms.
STATE = _schema("session_id string, status string, last_time_updated bigint, time_processed bigint, error string, chunks bigint, terms array<bigint>")
#: Postings carry what a search filters and scores by, so that a search reads nothing else of the chunks it cuts.
POSTING = _schema("source string, term string, id string, session_id string, project_path string, part_type string, time_created bigint, position int, length int, positions array<int>")
#: home: the segment of the chunk.
VECTOR = _schema("id string, session_id string, project_path string, part_type string, time_created bigint, position int, home string, embedding array<float>")
#: Sessions whose rows in the segment ``of`` are dead.
DEAD = _schema("session_id string, of string")
SCHEMA_VERSION = 2

INDEXED_TYPES = ("text", "tool", "reasoning", "patch")
EMBEDDED_TYPES = ("text", "tool")
NO_PROJECT = "(global)"


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
