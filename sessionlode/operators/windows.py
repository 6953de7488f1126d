"""Reads by coordinate: windows of parts, session maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.sources import parts as P


def window(parts: DataFrame, roles: DataFrame, start: int, end: int, output_chars: int = T.READ_OUTPUT_CHARS) -> DataFrame:
    """Parts at positions start..end with full contents, in order. Tool outputs are cut; a broken payload fails the read."""
    data, kind = F.col("payload"), F.col("type")
    known = kind.isin("text", "reasoning", "tool", "patch")
    broken = known & ~P.valid(data, kind)
    of = lambda t, c: F.when(kind.isin(*t), c)
    rows = parts.where(F.col("position").between(start, end)).join(roles.select(F.col("id").alias("message_id"), "role"), "message_id", "left")
    return rows.select(
        "id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.when(broken, F.raise_error(F.concat(F.lit("broken payload of part "), F.col("id"))).cast("string")).otherwise(kind).alias("type"),
        of(["tool"], P.field(data, "tool")).alias("tool"),
        of(["tool"], P.field(data, "command")).alias("command"),
        of(["text", "reasoning"], P.field(data, "text")).alias("text"),
        of(["tool"], T.cut(P.field(data, "output"), output_chars)).alias("output"),
        of(["patch"], P.files(data)).alias("files"),
        "position",
        "time_created",
    ).orderBy("position")


def message_map(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages in order with the types of their parts (an empty array for none)."""
    types = parts.groupBy("message_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "type"))), lambda x: x["type"]).alias("part_types"))
    rows = messages.join(types, messages["id"] == types["message_id"], "left")
    return rows.select("session_id", "id", "role", "time_created", F.coalesce("part_types", F.array().cast("array<string>")).alias("part_types")).orderBy("session_id", "time_created", "id")
