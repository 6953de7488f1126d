"""JSON payloads of messages, sessions and parts.

Types are checked as strictly as a typed decoder does: a field of another type makes the whole part invalid, while a
missing or null field reads as empty. Keys are case-sensitive. A payload is parsed once, by ``parse``; the other functions of
parts take the parsed column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_DATA = "role string, agent string, model struct<modelID:string>"
MODEL_DATA = "id string, providerID string, variant string"
#: JSON paths of the text fields of each part type.
TEXT_FIELDS = {
    "text": {"text": "$.text"},
    "reasoning": {"text": "$.text"},
    "tool": {"tool": "$.tool", "call_id": "$.callID", "status": "$.state.status", "command": "$.state.input.command", "description": "$.state.input.description", "output": "$.state.output"},
    "patch": {"hash": "$.hash"},
    "compaction": {"tail_start_id": "$.tail_start_id"},
}
#: Fields that must be objects, and flags.
OBJECTS = {"tool": ("$.state", "$.state.input")}
FLAGS = {"compaction": ("$.auto", "$.overflow")}


def parse(data: Column) -> Column:
    """The payload as a variant; null where it is no JSON."""
    return F.try_parse_json(data)


def _kind(parsed: Column, path: str) -> Column:
    """The type of a JSON field; null if it is missing or null."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(kind != "VOID", kind)


def _text(parsed: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit(""))


def type_of(parsed: Column) -> Column:
    """The part's type: empty where the payload is no JSON or names none."""
    return _text(parsed, "$.type")


def valid(parsed: Column, kind: Column) -> Column:
    """Whether the payload decodes as a part of its type; other types always do, if they are JSON."""
    out = parsed.isNotNull()
    for name in TEXT_FIELDS:
        ok = F.schema_of_variant(parsed).startswith("OBJECT")
        for path in TEXT_FIELDS[name].values():
            ok = ok & (F.coalesce(_kind(parsed, path), F.lit("STRING")) == "STRING")
        for path in OBJECTS.get(name, ()):
            ok = ok & F.coalesce(_kind(parsed, path), F.lit("OBJECT")).startswith("OBJECT")
        for path in FLAGS.get(name, ()):
            ok = ok & (F.coalesce(_kind(parsed, path), F.lit("BOOLEAN")) == "BOOLEAN")
        if name == "patch":
            files = F.coalesce(_kind(parsed, "$.files"), F.lit("ARRAY<VOID>"))
            ok = ok & files.isin("ARRAY<VOID>", "ARRAY<STRING>")
        out = F.when(kind == name, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def field(parsed: Column, name: str) -> Column:
    """A text field by its column name."""
    path = next(fields[name] for fields in TEXT_FIELDS.values() if name in fields)
    return _text(parsed, path)


def files(parsed: Column) -> Column:
    """The files of a patch; empty if there are none."""
    out = F.try_variant_get(parsed, "$.files", "array<string>")
    return F.coalesce(F.transform(out, lambda x: F.coalesce(x, F.lit(""))), F.array().cast("array<string>"))


def message(data: Column) -> Column:
    """role, agent and model id; all empty where the payload is broken, so the message stays."""
    m = F.from_json(data, MESSAGE_DATA)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(text(m["role"]).alias("role"), text(m["agent"]).alias("agent"), text(m["model"]["modelID"]).alias("model_id"))


def model(data: Column) -> Column:
    """id, providerID and variant of a session's model; empty where it is broken."""
    m = F.from_json(data, MODEL_DATA)
    return F.struct(*[F.coalesce(m[k], F.lit("")).alias(k) for k in ("id", "providerID", "variant")])
