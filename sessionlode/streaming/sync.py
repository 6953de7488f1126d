"""Keeps an index in step with a growing history: new session rows arrive as files, each micro-batch is an index run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlode import schemas
from sessionlode.plans.index import Index
from sessionlode.sources.embedder import Embedder
from sessionlode.sources.history import History


def sync_stream(spark: SparkSession, sessions_path: str, history: Callable[[], History], index: Index, checkpoint: str, embedder: Embedder | None = None, once: bool = False) -> StreamingQuery:
    """Starts a query over Parquet files of session rows. A batch names the sessions to look at; what they hold is read from
    the history as it is then. A session that is up to date is skipped, so a batch that is run again changes nothing.
    """
    rows = spark.readStream.schema(schemas.SESSION).parquet(sessions_path)

    def run(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), "time_updated").alias("s")).select("s.*")
        h = history()
        index.run(History(h.project, newest, h.message, h.part), embedder=embedder)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
