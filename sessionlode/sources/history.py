"""Session history: four tables, read-only, and the scans and lookups on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sessionlode.schemas import NO_PROJECT
from sessionlode.sources import parts as P


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class History:
    """Tables as in ``schemas``. Sessions are the unit of every read: filters on session ids reach the scans."""

    project: DataFrame
    session: DataFrame
    message: DataFrame
    part: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        return cls(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("project", "session", "message", "part")))

    def projects(self) -> DataFrame:
        return self.project.select("id", "worktree", F.coalesce("vcs", F.lit("")).alias("vcs"), F.coalesce("name", F.lit("")).alias("name"))

    def project_paths(self) -> DataFrame:
        """(project_id, project_path), without the default for sessions that have no project."""
        return self.project.select(F.col("id").alias("project_id"), F.col("worktree").alias("project_path"))

    def sessions(self) -> DataFrame:
        """Newest first; ties by id. A null agent reads as empty."""
        model = P.model(F.col("model"))
        rows = self.session.withColumns({"agent": F.coalesce("agent", F.lit("")), "model": F.coalesce("model", F.lit(""))})
        return rows.withColumn("model_info", model).orderBy(F.desc("time_updated"), "id")

    def get_session(self, session_id: str) -> Row:
        rows = self.session.where(F.col("id") == session_id).limit(1).collect()
        if not rows:
            raise NotFound(f"session {session_id} not found")
        return rows[0]

    def messages(self, session_id: str | None = None) -> DataFrame:
        """Decoded messages in the order of (time, id); a broken payload leaves the role empty."""
        rows = self.message if session_id is None else self.message.where(F.col("session_id") == session_id)
        m = P.message(F.col("data"))
        rows = rows.select("id", "session_id", "time_created", "time_updated", m.alias("m")).select("id", "session_id", "time_created", "time_updated", "m.*")
        return rows if session_id is None else rows.orderBy("time_created", "id")

    def parts(self, session_id: str | None = None) -> DataFrame:
        """Parts with their parsed payload, type and position: from 0 in each session, over all parts that have a message, by message time and
        insertion. The session filter is below the window, so one session's rows are all that is read."""
        parts, messages = self.part, self.message
        if session_id is not None:
            parts, messages = parts.where(F.col("session_id") == session_id), messages.where(F.col("session_id") == session_id)
        joined = parts.join(messages.select(F.col("id").alias("message_id"), F.col("time_created").alias("message_time")), "message_id")
        order = Window.partitionBy("session_id").orderBy("message_time", "ord")
        placed = joined.withColumn("position", F.row_number().over(order) - 1)
        # Parsed above the window, so that only payloads are shuffled.
        parsed = placed.withColumn("payload", P.parse(F.col("data")))
        return parsed.select("id", "message_id", "session_id", "time_created", "time_updated", "data", "payload", P.type_of(F.col("payload")).alias("type"), "position")

    def find_part(self, part_id: str) -> Row:
        rows = self.part.where(F.col("id") == part_id).withColumn("type", P.type_of(P.parse(F.col("data")))).limit(1).collect()
        if not rows:
            raise NotFound(f"part {part_id} not found")
        return rows[0]

    def compaction(self, parts: DataFrame | None = None) -> DataFrame:
        """(session_id, compacted, tail_start_id): whether a session has a valid compaction part, and the last tail named."""
        parts = self.parts() if parts is None else parts
        return parts.groupBy("session_id").agg(*self.marks()).where("compacted")

    @staticmethod
    def marks() -> list[Column]:
        """The same as aggregates over a session's parts; not compacted and no tail where there is no such part."""
        kind, tail = F.col("type"), P.field(F.col("payload"), "tail_start_id")
        # Letters are only escaped as \\u, so other payloads need not be looked into.
        data = F.col("data")
        mark = F.coalesce((data.contains("compaction") | data.contains("\\u")) & (kind == "compaction") & P.valid(F.col("payload"), kind), F.lit(False))
        named = mark & (tail != "")
        return [F.bool_or(mark).alias("compacted"), F.coalesce(F.max_by(F.when(named, tail), F.when(named, F.col("position"))), F.lit("")).alias("tail_start_id")]

    def located(self, sessions: DataFrame) -> DataFrame:
        """Sessions with project_path; those without a project get the default."""
        path = F.when(F.coalesce("project_path", F.lit("")) == "", NO_PROJECT).otherwise(F.col("project_path"))
        return sessions.join(self.project_paths(), "project_id", "left").withColumn("project_path", path)


def from_conversations(conversations: DataFrame) -> History:
    """Reads (conv_id, turn, role, text) as history: a session per conversation, a message with one text part per turn."""
    spark = conversations.sparkSession
    sid = F.col("conv_id").cast("string")
    mid = F.concat_ws(":", sid, F.col("turn").cast("string"))
    time = F.col("turn").cast("long")
    message = conversations.select(mid.alias("id"), sid.alias("session_id"), time.alias("time_created"), time.alias("time_updated"), F.to_json(F.struct("role")).alias("data"))
    part = conversations.select(
        F.concat(F.lit("p:"), mid).alias("id"), mid.alias("message_id"), sid.alias("session_id"), time.alias("time_created"), time.alias("time_updated"),
        F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"), time.alias("ord"),
    )
    session = conversations.groupBy(sid.alias("id")).agg(F.min(time).alias("time_created"), F.max(time).alias("time_updated"))
    empty = F.lit("")
    session = session.select(
        "id", F.lit("p0").alias("project_id"), empty.alias("slug"), empty.alias("directory"), F.concat(F.lit("conversation "), "id").alias("title"), empty.alias("version"), empty.alias("agent"),
        F.lit("{}").alias("model"), "time_created", "time_updated", F.lit(None).cast("long").alias("time_archived"),
    )
    project = spark.createDataFrame([("p0", "/conversations", None, None)], "id string, worktree string, vcs string, name string")
    return History(project, session, message, part)
