"""What a job keeps on its way: tables in the folder that all machines share, which cut lineage, and held results."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sessionlode.sources.tables import shared_dir

#: What is read from files, and sent to Python, at a time.
SMALL = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "256",
}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside read and send rows in small batches, for less memory, above all where texts are long; then the
    settings are as before."""
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: For a shared folder of the scheme file: without checksum files. Where Hadoop's native library is missing, it starts three
#: processes for a file that has one, to set permissions. Other file systems do not look at this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Parquet tables under one new folder of the shared directory, and results held on the executors' disks.

    Tables go when the process ends, or at ``drop``. Held results keep their lineage, so what a lost executor held is
    computed again; they go at ``release``, once a table has what is needed of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.held: list[DataFrame] = []
        self.names: list[str] = []
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return self.held[-1]

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def table(self, df: DataFrame, name: str, wide: bool = False, packed: bool = False) -> DataFrame:
        """Writes and reads again. A wide table keeps its partitions, so that the work that makes it keeps its tasks; a narrow one
        gets no more files than the cluster has cores. Reading it again does not keep the order of rows. ``packed``: the table
        is mostly blocks of packed numbers, for which neither compression nor a dictionary is worth its time.
        """
        path = f"{self.root}/{name}"
        self.names.append(name)
        if not wide:
            df = df.coalesce(max(1, self.spark.sparkContext.defaultParallelism))
        options = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if packed else {}
        df.write.options(**PLAIN_FILES, **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Drops all tables but these, once nothing that is still to be computed reads them."""
        for name in set(self.names) - set(names):
            self.drop(name)
        self.names = list(names)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended already
            pass
