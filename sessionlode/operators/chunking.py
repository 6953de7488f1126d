"""From parts to chunks, the units of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.functions.stemmer import stem_text
from sessionlode.schemas import CHUNK, EMBEDDED_TYPES, INDEXED_TYPES
from sessionlode.sources import parts as P


def tool_content(tool: Column, command: Column, output: Column) -> Column:
    """tool [": " command] ["\\n" output]."""
    return F.concat(tool, F.when(command != "", F.concat(F.lit(": "), command)).otherwise(""), F.when(output != "", F.concat(F.lit("\n"), output)).otherwise(""))


def embed_text(content: Column, part_type: Column) -> Column:
    """What is embedded of a chunk; null where nothing is."""
    return F.when(part_type.isin(*EMBEDDED_TYPES), T.head(content, T.EMBED_CHARS))


def chunkify(parts: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Chunks of ``parts`` (as from ``History.parts``): none for service parts, broken payloads and empty contents.

    ``messages`` gives roles (a missing message: empty), ``sessions`` (id, project_id, project_path) the project. Positions
    keep the gaps that parts without a chunk leave.
    """
    data, kind = F.col("payload"), F.col("type")
    command, raw = T.clean(P.field(data, "command")), T.clean(P.field(data, "output"))
    fields = F.struct(
        (kind.isin(*INDEXED_TYPES) & P.valid(data, kind)).alias("ok"),
        F.when(kind == "tool", P.field(data, "tool")).otherwise("").alias("tool"),
        F.when(kind == "tool", command).otherwise("").alias("command"),
        F.when(kind == "tool", raw).otherwise("").alias("output"),
        F.when(kind.isin("text", "reasoning"), T.trim_space(P.field(data, "text"))).alias("said"),
        F.when(kind == "patch", P.files(data)).alias("files"),
    )
    # Generators of one row: filters stay above them, so that each payload is parsed, and each content made, once.
    rows = parts.select("id", "session_id", "message_id", "position", "time_created", "time_updated", kind.alias("part_type"), F.inline(F.array(fields))).where("ok")
    content = (
        F.when(F.col("part_type") == "tool", T.clean(tool_content(F.col("tool"), F.col("command"), T.head(F.col("output"), T.TOOL_OUTPUT_CHARS))))
        .when(F.col("part_type") == "patch", F.array_join("files", "\n"))
        .otherwise(F.col("said"))
    )
    made = F.struct(content.alias("content"), (F.length("output") > T.TOOL_OUTPUT_CHARS).alias("truncated"))
    rows = rows.select("id", "session_id", "message_id", "position", "time_created", "time_updated", "part_type", "tool", "command", "files", F.inline(F.array(made)))
    rows = rows.where(F.when(F.col("part_type") == "patch", F.size("files") > 0).otherwise(F.col("content") != ""))
    roles = messages.select(F.col("id").alias("message_id"), F.col("role").alias("msg_role"))
    where = sessions.select(F.col("id").alias("session_id"), "project_id", "project_path")
    rows = rows.join(roles, "message_id", "left").join(where, "session_id", "left").withColumn("msg_role", F.coalesce("msg_role", F.lit("")))
    # After the joins, so that the content is shuffled once and not with what derives from it.
    shown = F.when(F.col("part_type") == "patch", F.concat(F.lit("patch: "), T.snippet(F.array_join("files", ", ")))).otherwise(T.snippet(F.col("content")))
    rows = rows.withColumns({
        "snippet": shown,
        "embed_text": embed_text(F.col("content"), F.col("part_type")),
        "stemmed": stem_text(T.words(F.col("content"))),
        "embedded": F.lit(False),
    })
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CHUNK.fields])


def invalid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without an id, session, project path or content, or with a negative position; a sound index has none."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return chunks.where(missing("id") | missing("session_id") | missing("project_path") | missing("content") | (F.col("position") < 0))


def describe(data: Column, kind: Column) -> Column:
    """One line about a part with a parsed payload, for listings."""
    short = lambda name, n: T.snippet(P.field(data, name), n)
    ok = P.valid(data, kind)
    files = P.files(data)
    told = (
        F.when(kind == "text", F.concat(F.lit("text: "), short("text", 100)))
        .when(kind == "reasoning", F.concat(F.lit("reasoning: "), short("text", 100)))
        .when(kind == "tool", F.concat(F.lit("tool "), P.field(data, "tool"), F.lit(": "), short("command", 60), F.lit(" -> "), short("output", 60)))
        .when(kind == "patch", F.concat(F.lit("patch "), F.size(files).cast("string"), F.lit(" files: "), T.snippet(F.array_join(files, ", "), 80)))
        .when(kind == "compaction", F.concat(F.lit("compaction (tail="), P.field(data, "tail_start_id"), F.lit(")")))
        .otherwise(kind)
    )
    return F.when(kind.isin("text", "reasoning", "tool", "patch") & ~ok, F.concat(kind, F.lit(" (parse error)"))).when((kind == "compaction") & ~ok, F.lit("compaction (tail=)")).otherwise(told)
