"""The index: immutable segments, and a manifest that makes a run visible at once.

A run writes the rows of its sessions as one new segment under a name of its own, then a new manifest. Rows of an older
segment whose session was indexed anew are dead: the newer segment lists them, and they go when segments are compacted. So the
cost of a run follows what changed, readers never see half a run, and a run that dies leaves nothing behind but files that no
manifest names; the next run is not in their way, nor they in its.

A segment holds chunks, sessions, state, postings (of all sources, each file of one of them and sorted by term) and vectors; a backfill adds a
segment of vectors only. The manifest holds what a search needs of the whole: the number of live chunks and of their terms.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode import schemas
from sessionlode.functions import text as T
from sessionlode.operators import chunking, fulltext
from sessionlode.plans.progress import Progress
from sessionlode.sources.embedder import Embedder, EmbeddingCache, embed_cached
from sessionlode.sources.history import History

#: Sources of postings and what they hold: raw terms, stemmed terms, and the two analyzers of the second lexical source.
POSTINGS = {"fts_unicode": "content", "fts_stem": "stemmed", "lex_stem": "stemmed", "lex_simple": "content"}
LEXICAL = tuple(x for x in POSTINGS if x.startswith("lex"))
FIRST_SCHEMA = 1


def letters(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


ANALYZERS = {"fts_unicode": T.terms, "fts_stem": T.terms, "lex_stem": T.words, "lex_simple": letters}


class IndexError_(RuntimeError):
    pass


@dataclass
class Stats:
    """Counters of a run."""

    sessions: int = 0
    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    chunks: int = 0
    embedded: int = 0
    pending: int = 0
    backfilled: int = 0
    empty: int = 0


@dataclass
class Manifest:
    version: int = 0
    #: Segments in the order in which they were written; those with vectors, with dead rows of others, with the second lexical source.
    segments: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    lexical: list[str] = field(default_factory=list)
    #: Live chunks, and live terms by source.
    chunks: int = 0
    terms: dict[str, int] = field(default_factory=dict)
    dim: int = 0
    model: str = ""
    schema_version: int = schemas.SCHEMA_VERSION


class Index:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    # Files, through Hadoop's file systems.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int, model: str = "") -> Index:
        """Opens or creates. The dimension must be positive and that of the index; the model may change.

        An index of an older schema is brought up to date step by step, one of a newer schema is refused.
        """
        if dim <= 0:
            raise IndexError_(f"dimension must be positive, not {dim}")
        index = cls(spark, path, Manifest(dim=dim, model=model))
        found = index._read_manifest()
        if found is None:
            index._commit()
            return index
        made = found.get("schema_version", FIRST_SCHEMA)
        if made > schemas.SCHEMA_VERSION:
            raise IndexError_(f"the index has schema {made}, newer than {schemas.SCHEMA_VERSION}")
        if found["dim"] != dim:
            raise IndexError_(f"dimension mismatch: the index has {found['dim']}, {dim} is asked for")
        for version in range(made, schemas.SCHEMA_VERSION):
            found = MIGRATIONS[version](index, found)
        index.manifest = Manifest(**found)
        if model and model != index.manifest.model:
            index._commit(model=model)
        return index

    def _read_manifest(self) -> dict | None:
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith("."))
        if not names:
            return None
        stream = fs.open(self._fs(f"{self.path}/manifests/{names[-1]}")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, **changes) -> None:
        """Writes the next manifest. It is written aside and moved to its name, which fails if the name is taken: of two
        writers of one version the second fails."""
        new = Manifest(**(vars(self.manifest) | {"version": self.manifest.version + 1} | changes))
        fs, part = self._fs(f"{self.path}/manifests/.{new.version:08d}-{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(vars(new)).encode()))
        stream.close()
        target = self._fs(f"{self.path}/manifests/{new.version:08d}.json")[1]
        jvm = self.spark._jvm
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(part).toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context.rename(fs.makeQualified(part), fs.makeQualified(target), none)
        except Exception as error:
            fs.delete(part, False)
            raise IndexError_(f"version {new.version} was not written, another run may have been first: {str(error).splitlines()[0]}") from error
        self.manifest = new

    def _new_segment(self) -> str:
        """A name that no other run has, not even one that died."""
        return uuid.uuid4().hex

    # Reading.

    def _table(self, name: str, schema, segments: list[str]) -> DataFrame:
        """All rows of the segments, with their segment; only their folders are read."""
        if not segments:
            return self.spark.createDataFrame([], schemas.ddl(schema)).withColumn("seg", F.lit(""))
        paths = [f"{self.path}/{name}/seg={s}" for s in segments]
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{schemas.ddl(schema)}, seg string").parquet(*paths)

    def _live(self, rows: DataFrame, session: str = "session_id", seg: str = "seg") -> DataFrame:
        """Rows without those of sessions that a later segment has indexed anew. What is dead follows what has changed since
        the last compaction, and is small beside the rows."""
        if not self.manifest.dead:
            return rows
        dead = self._table("dead", schemas.DEAD, self.manifest.dead).select(F.col("session_id").alias(session), F.col("of").alias(seg)).distinct()
        return rows.join(dead, [session, seg], "left_anti")

    def chunks(self) -> DataFrame:
        return self._live(self._table("chunks", schemas.CHUNK, self.manifest.segments)).drop("seg")

    def sessions(self) -> DataFrame:
        return self._live(self._table("sessions", schemas.SESSION_META, self.manifest.segments), "id").drop("seg")

    def _state(self) -> DataFrame:
        return self._live(self._table("state", schemas.STATE, self.manifest.segments))

    def state(self) -> DataFrame:
        return self._state().select(*schemas.SYNC_STATE.fieldNames())

    def vectors(self) -> DataFrame:
        """Vectors belong to the segment of their chunk (home), wherever they were written."""
        return self._live(self._table("vectors", schemas.VECTOR, self.manifest.vectors).drop("seg"), seg="home").drop("home")

    def postings(self, source: str) -> DataFrame:
        """(term, id, session_id, project_path, part_type, time_created, position, length, positions) of one source."""
        rows = self._table("postings", schemas.POSTING, self.manifest.lexical if source in LEXICAL else self.manifest.segments)
        return self._live(rows.where(F.col("source") == source)).drop("seg", "source")

    def stats(self, source: str) -> tuple[int, float]:
        """Live chunks and their mean number of terms."""
        n = self.manifest.chunks
        return n, self.manifest.terms.get(source, 0) / n if n else 0.0

    # Writing.

    def needs_indexing(self, sessions: DataFrame) -> DataFrame:
        """Sessions without a state, with an error, or updated after it."""
        state = self.state().select(F.col("session_id").alias("id"), "status", "last_time_updated")
        rows = sessions.join(state, "id", "left")
        return rows.where(F.col("status").isNull() | (F.col("status") == "error") | (F.col("time_updated") > F.col("last_time_updated"))).drop("status", "last_time_updated")

    def run(self, history: History, project: str | None = None, limit: int | None = None, embedder: Embedder | None = None, lexical: bool = True, cache: EmbeddingCache | None = None, backfill: bool = False, pause_s: float = 0.0, progress: Progress | None = None) -> Stats:
        """Brings the index up to date: one set-based job over all sessions that need it, newest first up to ``limit``.

        A session that yields no chunks any more loses its old ones. If embedding fails, rows are written without vectors
        and the sessions' state is an error, so the next run takes them again. ``pause_s`` makes executors wait after each
        call's batches. New vectors go into ``cache``, if there is one.
        """
        stats = Stats()
        sessions = history.located(history.session)
        if project:
            sessions = sessions.where(F.col("project_path") == project)
        stats.sessions = sessions.count()
        todo = self.needs_indexing(sessions)
        waiting = todo.count()
        if limit is not None and limit > 0:
            todo = todo.orderBy(F.desc("time_updated"), "id").limit(limit)
        stats.skipped = stats.sessions - waiting
        if progress is not None:
            progress.start(stats.sessions, waiting)
        step = progress.step if progress is not None else lambda name: None
        try:
            if waiting:
                self._index(history, todo, stats, embedder, lexical, cache, pause_s, step)
            if backfill and embedder is not None:
                step("backfill")
                stats.backfilled = self.backfill(embedder, cache=cache)
        finally:
            if progress is not None:
                progress.finish(stats)
        return stats

    def _index(self, history: History, todo: DataFrame, stats: Stats, embedder: Embedder | None, lexical: bool, cache: EmbeddingCache | None, pause_s: float, step: Callable[[str], None]) -> None:
        seg = self._new_segment()
        keys = todo.select(F.col("id").alias("session_id"))
        parts = History(history.project, todo, history.message.join(keys, "session_id", "left_semi"), history.part.join(keys, "session_id", "left_semi"))
        placed = parts.parts()
        step("chunks")
        chunks = self._write_chunks(seg, chunking.chunkify(placed, parts.messages(), todo))
        step("postings")
        self._write_postings(seg, chunks, lexical)
        error, embedded = "", False
        if embedder is not None:
            step("vectors")
            try:
                wanted = chunks.where(pending()).select("id", F.col("embed_text").alias("text"))
                vectors = cache.embedded(wanted, embedder, pause_s) if cache is not None else embed_cached(wanted, None, embedder, pause_s)[0]
                self._write_vectors(seg, chunks.withColumn("home", F.lit(seg)), vectors)
                embedded = True
            except Exception as failure:  # a failing service must not lose the texts
                error = f"embedding failed: {str(failure).splitlines()[0][:200]}"
        step("sessions")
        counts = chunks.groupBy("session_id").agg(F.count("*").alias("chunks_count"))
        totals = placed.groupBy("session_id").agg(F.count("*").alias("parts_count"), *parts.marks())
        meta = todo.withColumn("session_id", F.col("id")).join(totals, "session_id", "left").join(counts, "session_id", "left")
        meta = meta.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("parts_count", "chunks_count")} | {"compacted": F.coalesce("compacted", F.lit(False)), "tail_start_id": F.coalesce("tail_start_id", F.lit("")), "agent": F.coalesce("agent", F.lit(""))})
        meta.select(*[F.col(f.name).cast(f.dataType) for f in schemas.SESSION_META.fields]).write.parquet(f"{self.path}/sessions/seg={seg}")
        written = self.spark.read.schema(schemas.ddl(schemas.SESSION_META)).parquet(f"{self.path}/sessions/seg={seg}")
        state = written.select(F.col("id").alias("session_id"), F.lit("error" if error else "indexed").alias("status"), F.col("time_updated").alias("last_time_updated"), F.unix_millis(F.current_timestamp()).alias("time_processed"), F.lit(error).alias("error"))
        self._write_state(seg, state, written)
        # What the run's sessions had before is dead from now on.
        past = self._state().join(written.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        gone = self._sums(past)
        dead = []
        if self.manifest.segments:
            past.select("session_id", F.col("seg").alias("of")).write.parquet(f"{self.path}/dead/seg={seg}")
            dead = [seg]
        new = self._sums(self._table("state", schemas.STATE, [seg]))
        m = self.manifest
        self._commit(
            segments=[*m.segments, seg], vectors=[*m.vectors, *([seg] if embedded else [])], dead=[*m.dead, *dead], lexical=[*m.lexical, *([seg] if lexical else [])],
            chunks=m.chunks + new["chunks"] - gone["chunks"], terms={x: m.terms.get(x, 0) + new[x] - gone[x] for x in POSTINGS},
        )
        done = new["sessions"]
        stats.indexed, stats.failed = (0, done) if error else (done, 0)
        stats.chunks, stats.empty = new["chunks"], new["empty"]
        stats.embedded = self._table("vectors", schemas.VECTOR, [seg]).count() if embedded else 0
        stats.pending = self.pending_vectors().count()

    def _sums(self, state: DataFrame) -> dict[str, int]:
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        terms = [zero(F.get("terms", k)).alias(x) for k, x in enumerate(POSTINGS)]
        return state.agg(F.count("*").alias("sessions"), F.count_if(F.col("chunks") == 0).alias("empty"), zero(F.col("chunks")).alias("chunks"), *terms).first().asDict()

    def _write_chunks(self, seg: str, chunks: DataFrame) -> DataFrame:
        """Everything else derives from the written copy, so that nothing is computed twice."""
        chunks.write.parquet(f"{self.path}/chunks/seg={seg}")
        return self.spark.read.schema(schemas.ddl(schemas.CHUNK)).parquet(f"{self.path}/chunks/seg={seg}")

    def _write_postings(self, seg: str, chunks: DataFrame, lexical: bool) -> None:
        """Files of one source each, in the order of terms, from one pass over the chunks a source. Nothing is shuffled: a
        query reads few row groups of each file."""
        keep = ["id", "session_id", "project_path", "part_type", "time_created", "position"]
        for x, c in POSTINGS.items():
            if lexical or x not in LEXICAL:
                rows = fulltext.listed(chunks.select(*keep, ANALYZERS[x](F.col(c)).alias("tokens")), "tokens").withColumn("source", F.lit(x))
                rows.select(*schemas.POSTING.fieldNames()).sortWithinPartitions("term").write.mode("append").parquet(f"{self.path}/postings/seg={seg}")

    def _write_state(self, seg: str, state: DataFrame, sessions: DataFrame) -> None:
        """State with what each session adds to the totals."""
        postings = self._table("postings", schemas.POSTING, [seg])
        terms = postings.groupBy("session_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("source") == x, F.size("positions")).cast("long")), F.lit(0).cast("long")) for x in POSTINGS]).alias("terms"))
        rows = state.join(sessions.select(F.col("id").alias("session_id"), F.col("chunks_count").alias("chunks")), "session_id").join(terms, "session_id", "left")
        rows = rows.withColumn("terms", F.coalesce("terms", F.array(*[F.lit(0).cast("long")] * len(POSTINGS))))
        rows.select(*schemas.STATE.fieldNames()).write.parquet(f"{self.path}/state/seg={seg}")

    def _write_vectors(self, seg: str, chunks: DataFrame, vectors: DataFrame) -> None:
        rows = chunks.select("id", "session_id", "project_path", "part_type", "time_created", "position", "home").join(vectors, "id")
        rows.select(*schemas.VECTOR.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/vectors/seg={seg}")

    def pending_vectors(self) -> DataFrame:
        """Chunks that should have a vector and have none, with the segment they are in (home)."""
        chunks = self._live(self._table("chunks", schemas.CHUNK, self.manifest.segments)).withColumnRenamed("seg", "home")
        return chunks.where(pending()).join(self.vectors().select("id"), "id", "left_anti")

    def backfill(self, embedder: Embedder, limit: int | None = None, cache: EmbeddingCache | None = None) -> int:
        """Embeds what is pending, in the order of insertion, and writes a segment of these vectors only.

        All or nothing: a failing batch leaves the index as it was.
        """
        rows = self.pending_vectors()
        if limit is not None:
            rows = rows.orderBy("session_id", "position").limit(limit)
        wanted = rows.select("id", F.col("embed_text").alias("text"))
        seg = self._new_segment()
        self._write_vectors(seg, rows, cache.embedded(wanted, embedder) if cache is not None else embed_cached(wanted, None, embedder)[0])
        n = self._table("vectors", schemas.VECTOR, [seg]).count()
        if n:
            self._commit(vectors=[*self.manifest.vectors, seg])
        return n

    def compact(self, lexical: bool | None = None) -> None:
        """One segment with all live rows; old segments stay on disk until ``vacuum``. ``lexical`` makes the second lexical source
        anew for all of them, or drops it; without it, it stays as it is."""
        seg = self._new_segment()
        lexical = self.has_lexical() if lexical is None else lexical
        sessions, state, vectors = self.sessions(), self.state(), self.vectors()
        chunks = self._write_chunks(seg, self.chunks())
        self._write_postings(seg, chunks, lexical)
        vectors.withColumn("home", F.lit(seg)).select(*schemas.VECTOR.fieldNames()).write.parquet(f"{self.path}/vectors/seg={seg}")
        sessions.write.parquet(f"{self.path}/sessions/seg={seg}")
        self._write_state(seg, state, sessions)
        sums = self._sums(self._table("state", schemas.STATE, [seg]))
        self._commit(segments=[seg], vectors=[seg], dead=[], lexical=[seg] if lexical else [], chunks=sums["chunks"], terms={x: sums[x] for x in POSTINGS})

    def vacuum(self, older_than_s: float = 86_400.0) -> None:
        """Deletes segments that the manifest does not name and that are older than any running job can be."""
        named = {*self.manifest.segments, *self.manifest.vectors}
        now = self.spark._jvm.System.currentTimeMillis()
        for name in ("chunks", "sessions", "state", "vectors", "dead", "postings"):
            fs, p = self._fs(f"{self.path}/{name}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName().removeprefix("seg=") not in named and now - f.getModificationTime() >= older_than_s * 1000:
                    fs.delete(f.getPath(), True)

    def has_lexical(self) -> bool:
        """Whether all segments have the second lexical source."""
        return bool(self.manifest.segments) and set(self.manifest.segments) <= set(self.manifest.lexical)

    def failed_sessions(self) -> DataFrame:
        return self.state().where("status = 'error'").orderBy("session_id")

    def status(self) -> dict:
        counts = {"sessions": self.sessions().count(), "chunks": self.chunks().count(), "vectors": self.vectors().count(), "pending_vectors": self.pending_vectors().count()}
        last = self.state().agg(F.coalesce(F.max("time_processed"), F.lit(0).cast("long"))).first()[0]
        return counts | {"embed_dim": self.manifest.dim, "embed_model": self.manifest.model, "last_sync": last, "schema_version": self.manifest.schema_version}


def pending() -> Column:
    return ~F.col("embedded") & F.col("embed_text").isNotNull() & (F.col("embed_text") != "")


def _from_first(index: Index, found: dict) -> dict:
    """Schema 1 numbered its segments, had a session's rows live in the highest number, and kept no totals: all live rows are
    written anew as one segment."""
    old = [str(s) for s in found["segments"]]
    index.manifest = Manifest(version=found["version"], dim=found["dim"], model=found["model"])
    if old:
        state = index._table("state", schemas.SYNC_STATE, old)
        newest = state.groupBy("session_id").agg(F.max(F.col("seg").cast("long")).cast("string").alias("seg"))
        live = lambda name, schema, key="session_id": index._table(name, schema, old).join(newest.withColumnRenamed("session_id", key), [key, "seg"], "left_semi").drop("seg")
        there = lambda name: all(index._fs(f"{index.path}/{name}/seg={s}")[0].exists(index._fs(f"{index.path}/{name}/seg={s}")[1]) for s in old)
        seg = index._new_segment()
        chunks = index._write_chunks(seg, live("chunks", schemas.CHUNK))
        lexical = there("lex_simple")
        index._write_postings(seg, chunks, lexical)
        sessions = live("sessions", schemas.SESSION_META, "id")
        sessions.write.parquet(f"{index.path}/sessions/seg={seg}")
        index._write_state(seg, live("state", schemas.SYNC_STATE), sessions)
        with_vectors = [s for s in old if index._fs(f"{index.path}/vectors/seg={s}")[0].exists(index._fs(f"{index.path}/vectors/seg={s}")[1])]
        vectors = index._table("vectors", schemas.VECTOR, with_vectors).join(newest, ["session_id", "seg"], "left_semi").withColumn("home", F.lit(seg))
        vectors.select(*schemas.VECTOR.fieldNames()).write.parquet(f"{index.path}/vectors/seg={seg}")
        sums = index._sums(index._table("state", schemas.STATE, [seg]))
        index._commit(segments=[seg], vectors=[seg], lexical=[seg] if lexical else [], chunks=sums["chunks"], terms={x: sums[x] for x in POSTINGS})
    else:
        index._commit()
    return vars(index.manifest)


#: What brings a manifest of each schema to the next one.
MIGRATIONS = {1: _from_first}
